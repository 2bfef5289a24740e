"""Tree models in LightGBM's text format: scores, contributions, calibration and reasons."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import KIND_OF, STRING
from tidemark.functions.words import figure
from tidemark.shipping import ship

#: Smaller magnitudes reach a tree as zero: float32's 1e-35 (a fixed value of the format).
ZERO = float(np.float32(1e-35))
CATEGORICAL, DEFAULT_LEFT = 1, 2
MISSING_NONE, MISSING_ZERO, MISSING_NAN = 0, 1, 2


@dataclass(frozen=True)
class Tree:
    """Arrays by node; a child below 0 is leaf ~child. inner: values at nodes; bits: each categorical node's words."""

    leaf: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    kind: np.ndarray
    left: np.ndarray
    right: np.ndarray
    inner: np.ndarray
    bits: tuple[np.ndarray | None, ...]

    def goes_left(self, node: int, v: np.ndarray) -> np.ndarray:
        """Which of these values of the node's feature go left."""
        kind = int(self.kind[node])
        if kind & CATEGORICAL:
            words = self.bits[node]
            size = 32 * len(words)
            inside = ~np.isnan(v) & (v > -1) & (v < size)
            c = np.where(inside, v, 0).astype(np.int64)  # towards zero
            return inside & ((words[c >> 5] >> (c & 31).astype(np.uint32)) & 1).astype(bool) if size else np.zeros(len(v), bool)
        missing = (kind >> 2) & 3
        nan = np.isnan(v)
        x = np.where(nan | (np.abs(v) <= ZERO), 0.0, v)
        left = x <= self.threshold[node]
        default = bool(kind & DEFAULT_LEFT)
        if missing == MISSING_NAN:
            return np.where(nan, default, left)
        if missing == MISSING_ZERO:
            return np.where(x == 0, default, left)
        return left

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(node, rows there, whether each goes left), node by node; parents come before children."""
        if not len(self.feature):
            return
        at = {0: np.arange(len(x))}
        for node in range(len(self.feature)):
            rows = at.pop(node, None)
            if rows is None or not len(rows):
                continue
            left = self.goes_left(node, x[rows, self.feature[node]])
            yield node, rows, left
            for child, part in ((int(self.left[node]), rows[left]), (int(self.right[node]), rows[~left])):
                if child >= 0:
                    at[child] = part

    def value(self, child: int) -> float:
        return float(self.inner[child] if child >= 0 else self.leaf[~child])


@dataclass(frozen=True)
class Model:
    features: tuple[str, ...]
    sigmoid: float
    trees: tuple[Tree, ...]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for rows of features (NaN: missing): leaves added in file order, as doubles."""
        total = np.zeros(len(x))
        for tree in self.trees:
            out = np.full(len(x), tree.leaf[0])
            for node, rows, left in tree.walk(x):
                for child, part in ((int(tree.left[node]), rows[left]), (int(tree.right[node]), rows[~left])):
                    if child < 0:
                        out[part] = tree.leaf[~child]
            total = total + out
        return total

    def contributions(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """What each feature added on the paths taken, by rows and features, and the bias."""
        out, bias = np.zeros(x.shape), 0.0
        for tree in self.trees:
            bias += float(tree.inner[0] if len(tree.feature) else tree.leaf[0])
            for node, rows, left in tree.walk(x):
                f, here = int(tree.feature[node]), float(tree.inner[node])
                step = np.where(left, tree.value(int(tree.left[node])) - here, tree.value(int(tree.right[node])) - here)
                out[rows, f] += step
        return out, bias

    def test_sql(self, tree: Tree, node: int, engine: str = "spark") -> str:
        """Whether a row goes left at a node, as SQL."""
        name, kind = self.features[tree.feature[node]], int(tree.kind[node])
        cut = f"CAST({float(tree.threshold[node])!r} AS DOUBLE)"
        if kind & CATEGORICAL:
            inside = [c for c in range(32 * len(tree.bits[node])) if tree.bits[node][c >> 5] >> np.uint32(c & 31) & 1]
            whole = f"trunc({name})" if engine == "duckdb" else name
            return f"coalesce({name} > -1 AND {name} < {32 * len(tree.bits[node])} AND CAST({whole} AS INT) IN ({', '.join(map(str, inside)) or '-1'}), false)"
        zeroed = f"(CASE WHEN {name} IS NULL OR abs({name}) <= {ZERO!r} THEN 0.0 ELSE {name} END)"
        default = "true" if kind & DEFAULT_LEFT else "false"
        left = f"{zeroed} <= {cut}"
        if (kind >> 2) & 3 == MISSING_NAN:
            return f"(CASE WHEN {name} IS NULL THEN {default} ELSE {left} END)"
        if (kind >> 2) & 3 == MISSING_ZERO:
            return f"(CASE WHEN {zeroed} = 0 THEN {default} ELSE {left} END)"
        return left

    def sql(self, engine: str = "spark") -> str:
        """The raw score as one nested CASE per tree, for small models and other engines."""

        def branch(tree: Tree, child: int) -> str:
            if child < 0 or not len(tree.feature):
                return f"CAST({float(tree.leaf[~child if child < 0 else 0])!r} AS DOUBLE)"
            return f"(CASE WHEN {self.test_sql(tree, child, engine)} THEN {branch(tree, int(tree.left[child]))} ELSE {branch(tree, int(tree.right[child]))} END)"

        return " + ".join(["CAST(0 AS DOUBLE)", *(branch(t, 0) for t in self.trees)])


class ModelError(ValueError):
    """A model file is not what this reads."""


def _array(block: dict[str, str], key: str, n: int, kind=float) -> np.ndarray:
    values = block.get(key, "").split()
    if len(values) != n:
        raise ModelError(f"{key} has {len(values)} values, not {n}")
    return np.array([kind(v) for v in values])


def _tree(block: dict[str, str], n_features: int) -> Tree:
    leaves = int(block["num_leaves"])
    if block.get("is_linear", "0") not in ("", "0"):
        raise ModelError("linear trees are not read")
    n = leaves - 1
    leaf = _array(block, "leaf_value", leaves)
    if leaves < 1:
        raise ModelError("a tree without leaves")
    if not n:
        empty = np.empty(0, np.int64)
        return Tree(leaf, empty, np.empty(0), empty, empty, empty, np.empty(0), ())
    feature, kind, left, right = (_array(block, k, n, int) for k in ("split_feature", "decision_type", "left_child", "right_child"))
    threshold, inner = _array(block, "threshold", n), _array(block, "internal_value", n)
    bits: list[np.ndarray | None] = [None] * n
    n_cat = int(block.get("num_cat") or 0)
    bounds = _array(block, "cat_boundaries", n_cat + 1, int) if n_cat else np.zeros(1, int)
    words = np.array(block.get("cat_threshold", "").split(), np.uint32)
    if n_cat and (len(words) != bounds[-1] or (np.diff(bounds) < 0).any()):
        raise ModelError("categorical bit sets don't fit their bounds")
    for i in range(n):
        if not 0 <= feature[i] < n_features:
            raise ModelError(f"node {i} splits on feature {feature[i]}")
        if any(c >= n or 0 <= c <= i or c < 0 and ~c >= leaves for c in (left[i], right[i])):
            raise ModelError(f"node {i} has a child out of range")
        if (kind[i] >> 2) & 3 > MISSING_NAN:
            raise ModelError(f"node {i} has an unknown missing type")
        if kind[i] & CATEGORICAL:
            which = int(threshold[i])
            if which != threshold[i] or not 0 <= which < n_cat:
                raise ModelError(f"node {i} names bit set {threshold[i]}")
            bits[i] = words[bounds[which] : bounds[which + 1]]
    return Tree(leaf, feature, threshold, kind, left, right, inner, tuple(bits))


def parse_model(text: str) -> Model:
    """A binary model of the v4 text format; anything else is refused."""
    head, sep, _ = text.partition("end of trees")
    if not sep:
        raise ModelError("the file has no end of trees; is it cut off?")
    parts = head.split("\nTree=")
    blocks = []
    for i, part in enumerate(parts):
        lines = part.strip().split("\n")
        if i and lines[0].strip() != str(i - 1):
            raise ModelError(f"Tree={lines[0]} comes where {i - 1} should")
        pairs = {}
        for line in lines[1:]:
            key, eq, value = line.strip().partition("=")
            if line.strip() and not eq:
                raise ModelError(f"unexpected line {line[:40]!r}")
            pairs[key] = value
        blocks.append(pairs)
    top = blocks[0]
    objective = top.get("objective", "").split()
    for bad, why in (
        (top.get("version") != "v4", "the version is not v4"),
        (top.get("num_class") != "1" or top.get("num_tree_per_iteration") != "1", "only binary models are read"),
        ("average_output" in top, "random forests are not read"),
        (objective[:1] != ["binary"], "the objective is not binary"),
        (len(blocks) < 2, "the model has no trees"),
    ):
        if bad:
            raise ModelError(why)
    sigmoid = next((float(x.partition(":")[2]) for x in objective if x.startswith("sigmoid:")), 1.0)
    features = tuple(top["feature_names"].split())
    if len(features) != int(top["max_feature_idx"]) + 1 or sigmoid <= 0:
        raise ModelError("feature names or sigmoid don't fit the header")
    return Model(features, sigmoid, tuple(_tree(b, len(features)) for b in blocks[1:]))


def model_text(model: Model) -> str:
    """The model in the text format, as parse_model reads it; for models of numeric splits."""
    if any(b is not None for t in model.trees for b in t.bits):
        raise ModelError("only numeric splits are written")
    lines = ["tree", "version=v4", "num_class=1", "num_tree_per_iteration=1", "label_index=0", f"max_feature_idx={len(model.features) - 1}", f"objective=binary sigmoid:{model.sigmoid:g}", f"feature_names={' '.join(model.features)}", ""]
    for i, t in enumerate(model.trees):
        lines += [f"Tree={i}", f"num_leaves={len(t.leaf)}", "num_cat=0"]
        columns = {"split_feature": t.feature, "threshold": t.threshold, "decision_type": t.kind, "left_child": t.left, "right_child": t.right, "leaf_value": t.leaf, "internal_value": t.inner}
        lines += [f"{name}={' '.join(repr(v) for v in column.tolist())}" for name, column in columns.items()]
        lines += ["shrinkage=1", ""]
    return "\n".join([*lines, "end of trees", ""])


# -- encoding ---------------------------------------------------------------------


#: Values in all of an encoder's fields, and of one field that are compared one by one rather than looked up.
MAX_VALUES, LISTED_VALUES = 100_000, 32


def fit_encoder(train: DataFrame, fields: Sequence[str]) -> dict[str, list[str]]:
    """The sorted distinct values of each text field in the training rows; a value's code is its place.

    Trees split on sets of codes, so an encoder is small by nature; one of over MAX_VALUES is refused before it is fetched.
    """
    sizes = train.agg(*[F.count_distinct(f).alias(f) for f in fields]).first().asDict()
    if sum(sizes.values()) > MAX_VALUES:
        raise ModelError(f"too many values for categories: {sizes}")
    row = train.agg(*[F.sort_array(F.collect_set(f)).alias(f) for f in fields]).first()
    return {f: list(row[f]) for f in fields}


def encode(df: DataFrame, encoder: dict[str, list[str]]) -> DataFrame:
    """df with each encoder field as its code; a missing or unseen value has none."""
    for name, values in encoder.items():
        df = df.withColumn(name, _code(name, values)) if len(values) <= LISTED_VALUES else _coded(df, name, values)
    return df


def _coded(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """df with codes looked up in a table of at most MAX_VALUES values, some megabytes, that is broadcast."""
    table = df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(values)], "_value string, _code double")
    columns = [F.col("_code").alias(c) if c == name else F.col(c) for c in df.columns]
    return df.join(F.broadcast(table), F.col(name) == F.col("_value"), "left").select(*columns)


def _code(name: str, values: list[str]) -> Column:
    if not values:
        return F.lit(None).cast("double")
    place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name))
    return F.when(place > 0, (place - 1).cast("double"))


# -- scoring ----------------------------------------------------------------------


@dataclass(frozen=True)
class Calibrator:
    """Isotonic steps: clipped at the ends, linear between."""

    x: tuple[float, ...]
    y: tuple[float, ...]

    @staticmethod
    def parse(text: str) -> Calibrator:
        d = json.loads(text)
        x, y = tuple(map(float, d["x"])), tuple(map(float, d["y"]))
        good = d.get("method") == "isotonic" and d.get("input") == "raw_score" and len(x) == len(y) > 0
        good = good and all(a < b for a, b in zip(x, x[1:], strict=False)) and all(a <= b for a, b in zip(y, y[1:], strict=False))
        if not (good and all(map(math.isfinite, x)) and all(0 <= v <= 1 for v in y)):
            raise ValueError("not an isotonic calibration of raw_score with rising steps")
        return Calibrator(x, y)

    def apply(self, raw: np.ndarray) -> np.ndarray:
        x, y = np.array(self.x), np.array(self.y)
        if len(x) == 1:
            return np.where(np.isnan(raw), np.nan, y[0])
        j = np.clip(np.searchsorted(x, raw, side="right") - 1, 0, len(x) - 2)
        slope = (y[j + 1] - y[j]) / (x[j + 1] - x[j])
        out = slope * (raw - x[j]) + y[j]
        out = np.where(raw <= x[0], y[0], np.where(raw >= x[-1], y[-1], out))
        return np.where(np.isnan(raw), np.nan, out)


def risk_score(p: Column) -> Column:
    """A probability in whole percent, 0 to 99; missing is 0."""
    return F.coalesce(F.least(F.greatest(F.floor(p * 100), F.lit(0)), F.lit(99)), F.lit(0)).cast("double")


def probability(raw: Column, sigmoid: float = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-sigmoid * raw))


def _matrix(block: Sequence[pd.Series] | pd.Series) -> np.ndarray:
    block = (block,) if isinstance(block, pd.Series) else block  # as the series of an only input comes
    return np.column_stack([s.to_numpy(dtype=np.float64, na_value=np.nan) for s in block]) if block else np.empty((0, 0))


def check_fit(model: Model, encoder: dict[str, list[str]]) -> None:
    for name in model.features:
        if name not in KIND_OF:
            raise ModelError(f"the model reads {name}, which the catalog lacks")
        if KIND_OF[name] == STRING and name not in encoder:
            raise ModelError(f"the model reads the text {name}, which the encoder lacks")


def score(df: DataFrame, model: Model, encoder: dict[str, list[str]], calibrator: Calibrator, contributions: bool = False) -> DataFrame:
    """df with raw_score, probability and risk_score; with contributions also bias and an array in feature order.

    Trees are walked in Arrow batches by rows, where long lists of values and
    the steps of the calibration are looked up too; df needs the model's
    features under their names, texts as texts.
    """
    ship(df.sparkSession)
    check_fit(model, encoder)
    inputs, places = [], {}
    for i, f in enumerate(model.features):
        if f in encoder and len(encoder[f]) > LISTED_VALUES:
            places[i] = {v: float(code) for code, v in enumerate(encoder[f])}
            inputs.append(F.col(f))
        else:
            inputs.append(_code(f, encoder[f]) if f in encoder else F.col(f).cast("double"))
    kind = "raw double, p double" + (", bias double, parts array<double>" if contributions else "")

    @F.pandas_udf(f"struct<{kind}>")
    def scored(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for block in parts:
            block = (block,) if isinstance(block, pd.Series) else block
            x = _matrix([s.map(places[i]) if i in places else s for i, s in enumerate(block)])
            raw = model.raw(x)
            out = pd.DataFrame({"raw": raw, "p": calibrator.apply(raw)})
            if contributions:
                each, bias = model.contributions(x)
                out = out.assign(bias=bias, parts=list(each))
            yield out

    named = {"raw_score": "raw", "probability": "p"} | ({"bias": "bias", "contributions": "parts"} if contributions else {})
    df = df.withColumn("_scored", scored(*inputs))
    df = df.withColumns({name: F.col(f"_scored.{field}") for name, field in named.items()})
    return df.withColumn("risk_score", risk_score(F.col("probability"))).drop("_scored")


def _ranked(contributions: Column, features: Sequence[str], by) -> Column:
    """Features with their contributions, by by(contribution) falling, then in feature order."""
    places = F.sequence(F.lit(0), F.lit(len(features) - 1))
    each = F.transform(places, lambda i: F.struct(F.get(contributions, i).alias("c"), F.get(F.array(*[F.lit(f) for f in features]), i).alias("f"), i.alias("i")))
    return F.sort_array(F.transform(each, lambda x: F.struct((-by(x["c"])).alias("k"), x["i"].alias("i"), x["f"].alias("f"), x["c"].alias("c"))))


def top_reasons(contributions: Column, features: Sequence[str], limit: int = 3) -> Column:
    """Names of the features that add most to the score, the first of equals first; only those that add."""
    adding = F.filter(_ranked(contributions, features, lambda c: c), lambda x: x["c"] > 0)
    return F.slice(F.transform(adding, lambda x: x["f"]), 1, limit)


def largest_contributions(contributions: Column, features: Sequence[str], limit: int) -> Column:
    """A map of the `limit` features with the largest contributions either way."""
    return F.map_from_entries(F.transform(F.slice(_ranked(contributions, features, F.abs), 1, limit), lambda x: F.struct(x["f"], x["c"])))


# -- reasons in words -------------------------------------------------------------


def reason(name: str, value: float | str | None, typical: float | str | None = None, contribution: float | None = None, known: bool = True) -> str:
    """One field as text: its value, and in brackets what is typical, which way it moves the score, and whether training never saw it."""
    notes = [] if typical is None else [f"typically {figure(typical)}"]
    if contribution:
        notes.append("raises the score" if contribution > 0 else "lowers the score")
    if not known:
        notes.append("not seen in training")
    return f"{name} is {figure(value)}" + (f" ({', '.join(notes)})" if notes else "")
