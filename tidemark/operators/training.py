"""Models trained with Spark ML: a logistic baseline, boosted trees, isotonic calibration; and a lock on test data."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import ranking
from tidemark.operators.model import DEFAULT_LEFT, MISSING_NAN, Calibrator, Model, Tree

#: Values of a text field that get a column of their own; all others share one.
TOP_VALUES = 19


def signed_log(x: Column) -> Column:
    """Tames sums and counts with long tails on both sides of zero."""
    return F.signum(x) * F.log1p(F.abs(x))


def prepared(df: DataFrame, numbers: Sequence[str], texts: Sequence[str], kept: dict[str, list[str]]) -> DataFrame:
    """df with l_<number> (signed log, null if missing), n_<number> (1 if missing) and t_<text> (a kept value, other or none)."""
    out = {f"l_{c}": signed_log(F.col(c)) for c in numbers} | {f"n_{c}": F.col(c).isNull().cast("double") for c in numbers}
    out |= {f"t_{c}": F.when(F.col(c).isNull(), "(none)").when(F.col(c).isin(*kept[c]) if kept[c] else F.lit(False), F.col(c)).otherwise("(other)") for c in texts}
    return df.withColumns(out)


def top_values(train: DataFrame, texts: Sequence[str], k: int = TOP_VALUES) -> dict[str, list[str]]:
    return {c: [r[0] for r in train.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(k).collect()] for c in texts}


class Baseline:
    """Logistic regression on imputed, standardised signed logs and one-hot texts."""

    def __init__(self, numbers: Sequence[str], texts: Sequence[str]):
        self.numbers, self.texts = list(numbers), list(texts)
        self.kept: dict[str, list[str]] = {}
        self.model: PipelineModel | None = None

    def fit(self, train: DataFrame, label: str = "fraud", reg: float = 1e-4) -> Baseline:
        self.kept = top_values(train, self.texts)
        logs, filled = [f"l_{c}" for c in self.numbers], [f"f_{c}" for c in self.numbers]
        stages = [Imputer(strategy="median", inputCols=logs, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_numbers"), StandardScaler(withMean=True, inputCol="_numbers", outputCol="_scaled")]
        hot = []
        for c in self.texts:
            stages += [StringIndexer(inputCol=f"t_{c}", outputCol=f"i_{c}", handleInvalid="keep"), OneHotEncoder(inputCol=f"i_{c}", outputCol=f"h_{c}")]
            hot.append(f"h_{c}")
        stages += [VectorAssembler(inputCols=["_scaled", *[f"n_{c}" for c in self.numbers], *hot], outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label, regParam=reg, maxIter=100)]
        rows = prepared(train.filter(F.col(label).isin(0, 1)), self.numbers, self.texts, self.kept).withColumn(label, F.col(label).cast("double"))
        self.model = Pipeline(stages=stages).fit(rows)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """df with p, the probability of fraud."""
        out = self.model.transform(prepared(df, self.numbers, self.texts, self.kept))
        return out.select(*df.columns, vector_to_array("probability")[1].alias("p"))


#: What stands for a missing number while trees grow: below any value, so it goes left at every split.
MISSING = -1e9
#: Depths and learning rates that are tried.
GRID = tuple({"maxDepth": d, "stepSize": s} for d in (4, 6) for s in (0.05, 0.1))


def boosted(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str = "fraud", grid: Sequence[dict] = GRID, rounds: int = 100) -> tuple[Model, dict]:
    """Boosted trees of the grid's best settings by average precision on valid, as a model for score(), and those settings.

    features are numbers (texts encoded); rows whose label isn't 0 or 1 are left
    out. At most `rounds` trees; none are added once the loss on valid stops falling.
    """
    known = [df.filter(F.col(label).isin(0, 1)).select(*[F.col(f).cast("double") for f in features], F.col(label).cast("double"), F.lit(v).alias("_valid")) for df, v in ((train, False), (valid, True))]
    both = known[0].unionByName(known[1]).fillna(MISSING, subset=list(features))
    both = VectorAssembler(inputCols=list(features), outputCol="_x").transform(both).select("_x", label, "_valid").persist()
    best = None
    try:
        for settings in grid:
            trees = GBTClassifier(featuresCol="_x", labelCol=label, seed=7, maxIter=rounds, validationIndicatorCol="_valid", **settings).fit(both)
            scored = trees.transform(both.filter("_valid")).select(vector_to_array("probability")[1].alias("score"), label)
            ap = ranking(scored, "score", label).first().average_precision or 0.0
            if best is None or ap > best[0]:
                best = (ap, trees, settings)
    finally:
        both.unpersist()
    model = as_model(best[1], features)
    return model, {**best[2], "average_precision": best[0], "trees": len(model.trees)}


def as_model(trained: GBTClassificationModel, features: Sequence[str]) -> Model:
    """Trees trained here in the form that score() reads; a leaf holds its part of the log-odds, which are twice the sum of Spark's trees."""
    return Model(tuple(features), 1.0, tuple(_as_tree(t, 2.0 * w) for t, w in zip(trained.trees, trained.treeWeights, strict=True)))


def _as_tree(trained: DecisionTreeRegressionModel, weight: float) -> Tree:
    nodes: list[list] = []
    leaves: list[float] = []

    def take(node) -> int:
        if node.getClass().getSimpleName() == "LeafNode":
            leaves.append(weight * node.prediction())
            return ~(len(leaves) - 1)
        place = len(nodes)
        nodes.append([node.split().featureIndex(), node.split().threshold(), weight * node.prediction(), 0, 0])
        nodes[place][3], nodes[place][4] = take(node.leftChild()), take(node.rightChild())
        return place

    take(trained._call_java("rootNode"))
    column = lambda i, kind: np.array([n[i] for n in nodes], dtype=kind)
    kinds = np.full(len(nodes), DEFAULT_LEFT | MISSING_NAN << 2)
    return Tree(np.array(leaves), column(0, int), column(1, float), kinds, column(3, int), column(4, int), column(2, float), (None,) * len(nodes))


def fit_isotonic(df: DataFrame, raw: str = "raw_score", label: str = "fraud") -> Calibrator:
    """Isotonic steps of the label's rate by raw score, with values in 0 to 1 and scores strictly rising."""
    rows = df.filter(F.col(label).isin(0, 1) & F.col(raw).isNotNull()).select(F.col(raw).alias("features"), F.col(label).cast("double").alias("label"))
    model = IsotonicRegression().fit(rows)
    steps: dict[float, float] = {}
    for x, y in zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist(), strict=True):
        steps[x] = min(1.0, max(0.0, y))
    return Calibrator(tuple(sorted(steps)), tuple(steps[x] for x in sorted(steps)))


class TestLock:
    """Test data is looked at once: a second look with other choices is refused."""

    def __init__(self, path: str):
        self.path = path

    def open(self, choices: dict, data: str) -> None:
        """Allow a look with these choices at data of this fingerprint, or raise."""
        mine = hashlib.sha256(json.dumps([choices, data], sort_keys=True).encode()).hexdigest()
        try:
            with open(self.path, "x") as f:
                f.write(mine)
        except FileExistsError:
            with open(self.path) as f:
                if f.read().strip() != mine:
                    raise PermissionError("the test data was looked at with other choices; it can't be a test again") from None
