from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.words import figure
from tidemark.operators import metrics
from tidemark.operators import model as md
from tidemark.plans import samples

MODEL = samples.model()


def naive(model, x):
    """Raw score and contributions of one row, step by step."""
    raw, parts, bias = 0.0, [0.0] * len(model.features), 0.0
    for t in model.trees:
        if not len(t.feature):
            raw, bias = raw + t.leaf[0], bias + t.leaf[0]
            continue
        n, bias = 0, bias + t.inner[0]
        while n >= 0:
            v, kind = x[t.feature[n]], int(t.kind[n])
            if kind & 1:
                words = t.bits[n]
                left = v == v and -1 < v < 32 * len(words) and bool(int(words[int(v) >> 5]) >> (int(v) & 31) & 1)
            else:
                missing, nan = (kind >> 2) & 3, v != v
                z = 0.0 if nan or abs(v) <= md.ZERO else v
                default = bool(kind & 2)
                left = default if (missing == 2 and nan) or (missing == 1 and z == 0) else z <= t.threshold[n]
            child = int(t.left[n] if left else t.right[n])
            here = t.inner[n]
            there = t.inner[child] if child >= 0 else t.leaf[~child]
            parts[t.feature[n]] += there - here
            n = child
            if n < 0:
                raw += t.leaf[~n]
    return raw, parts, bias


def inputs(n=500):
    rng = np.random.default_rng(3)
    edge = [np.nan, 0.0, -0.0, md.ZERO, -md.ZERO, md.ZERO * 1.01, 40.5, np.nextafter(40.5, 99), 1.5, 120.0, 10.0, np.inf, -np.inf, -1.0, -0.5, 2.7, 31.0, 32.0, 1e18]
    return np.array([[rng.choice(edge) if rng.random() < 0.7 else rng.uniform(-5, 4000) for _ in MODEL.features] for _ in range(n)])


def test_scores_and_contributions_row_by_row():
    x = inputs()
    raw, (parts, bias) = MODEL.raw(x), MODEL.contributions(x)
    for i, row in enumerate(x):
        a, b, c = naive(MODEL, row)
        assert raw[i] == a and list(parts[i]) == b and bias == pytest.approx(c)
        assert parts[i].sum() + bias == pytest.approx(a)


def test_case_expression_scores_alike(spark):
    x = inputs(200)
    df = spark.createDataFrame([(i, *[None if v != v else float(v) for v in r]) for i, r in enumerate(x)], "i int, " + ", ".join(f"{f} double" for f in MODEL.features))
    got = [r[0] for r in df.filter("product_code IS NULL OR abs(product_code) < 1e9").orderBy("i").select(F.expr(MODEL.sql())).collect()]
    keep = [i for i, r in enumerate(x) if r[1] != r[1] or abs(r[1]) < 1e9]
    assert got == list(MODEL.raw(x[keep]))


@pytest.mark.parametrize(
    ("old", "new"),
    [("version=v4", "version=v3"), ("num_class=1", "num_class=3"), ("binary sigmoid:1", "regression"), ("end of trees", ""), ("Tree=1\n", "Tree=7\n"), ("threshold=40.5 0 1.5", "threshold=40.5 0"),
     ("left_child=1 -1 -3", "left_child=0 -1 -3"), ("split_feature=4", "split_feature=9"), ("threshold=40.5 0 1.5", "threshold=40.5 3 1.5"), ("decision_type=8", "decision_type=12"), ("cat_boundaries=0 1", "cat_boundaries=0 2"), ("is_linear=0", "is_linear=1"), ("max_feature_idx=4", "max_feature_idx=5")],
)
def test_other_files_are_refused(old, new):
    with pytest.raises((md.ModelError, ValueError, KeyError)):
        md.parse_model(samples.MODEL.replace(old, new, 1))


def test_calibration():
    c = samples.CALIBRATION
    raw = np.array([-9, -4, -3.25, -2.5, 0.49, 0.5, 7, np.nan])
    got = c.apply(raw)
    assert got[0] == got[1] == 0.002 and got[2] == pytest.approx(0.011) and got[3] == 0.02 and got[5] == got[6] == 0.83 and np.isnan(got[7])
    good = {"method": "isotonic", "input": "raw_score", "x": [0, 1], "y": [0.1, 0.2]}
    assert md.Calibrator.parse(json.dumps(good)).apply(np.array([0.5]))[0] == pytest.approx(0.15)
    for bad in ({"x": [1, 1]}, {"y": [0.2, 0.1]}, {"method": "sigmoid"}, {"x": []}, {"y": [0.1, 1.2]}):
        with pytest.raises(ValueError):
            md.Calibrator.parse(json.dumps(good | bad))


def test_scoring_frames(spark):
    rows = [(1, 10.0, "view", 2.0, None, 3.0), (2, None, "never", None, None, None), (3, 99.0, None, 0.0, 5.0, 500.0)]
    df = spark.createDataFrame(rows, "id int, amount double, product_code string, card_txn_count_24h double, card_seconds_since_last double, distance double")
    out = md.score(df, MODEL, samples.ENCODER, samples.CALIBRATION, contributions=True)
    got = out.withColumn("why", md.top_reasons(F.col("contributions"), MODEL.features, 2)).withColumn("most", md.largest_contributions(F.col("contributions"), MODEL.features, 2)).orderBy("id").collect()
    codes = {v: float(i) for i, v in enumerate(samples.ENCODER["product_code"])}
    for r, row in zip(got, rows, strict=True):
        x = [row[1], codes.get(row[2]), *row[3:]]
        a, parts, _ = naive(MODEL, [np.nan if v is None else v for v in x])
        assert r.raw_score == a and r.contributions == pytest.approx(parts) and 0 <= r.risk_score <= 99
        ranked = sorted((-c, i) for i, c in enumerate(parts) if c > 0)
        assert r.why == [MODEL.features[i] for _, i in ranked[:2]] and len(r.most) == 2
    assert [r[0] for r in spark.createDataFrame([(0.5,), (None,), (1.0,), (-1.0,), (0.999,)], "p double").select(md.risk_score(F.col("p"))).collect()] == [50, 0, 99, 0, 99]
    with pytest.raises(md.ModelError):
        md.score(df, MODEL, {}, samples.CALIBRATION)


def test_long_lists_of_values_and_steps(spark):
    values = [f"v{i:05}" for i in range(3_000)]
    steps = md.Calibrator(tuple(i / 1_000 for i in range(-3_000, 3_000)), tuple(i / 6_000 for i in range(6_000)))
    rows = [(i, float(i % 120), values[i * 7 % 3_000] if i % 5 else None if i % 2 else "unseen", 2.0, None, 3.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, amount double, product_code string, card_txn_count_24h double, card_seconds_since_last double, distance double")
    for r, row in zip(md.score(df, MODEL, {**samples.ENCODER, "product_code": values}, steps).orderBy("id").collect(), rows, strict=True):
        code = values.index(row[2]) if row[2] in values else np.nan
        raw = naive(MODEL, [row[1], float(code), row[3], np.nan, row[5]])[0]
        assert (r.raw_score, r.probability) == (raw, pytest.approx(steps.apply(np.array([raw]))[0])) and r.product_code == row[2]


def test_reasons():
    assert md.reason("card_txn_count_1h", 5.0, 1.0, 0.3) == "card_txn_count_1h is 5 (typically 1, raises the score)"
    assert md.reason("card_amount_sum_7d", None) == "card_amount_sum_7d is missing" and md.reason("distance", float("nan"), contribution=-1.0) == "distance is missing (lowers the score)"
    assert md.reason("product_code", "Q", known=False) == "product_code is Q (not seen in training)"


def test_figures():
    assert [figure(x) for x in (4.99, 25, 182346.7, -3.5, 99.999, 0.000123, 0, -1234.5, None, "x")] == ["4.99", "25", "182,347", "-3.5", "100", "0.000123", "0", "-1,234", "missing", "x"]


def test_metrics(spark):
    rng = np.random.default_rng(5)
    n = 600
    s, y, a = np.round(rng.uniform(0, 1, n), 2), rng.integers(0, 2, n), np.round(rng.uniform(1, 90, n), 2)
    y[:40] = 1 * (s[:40] > 0.5)
    df = spark.createDataFrame([(i, float(p), int(q), float(r)) for i, (p, q, r) in enumerate(zip(s, y, a, strict=True))], "id int, score double, fraud int, amount double")
    r = metrics.ranking(df, fpr=0.1).first()
    pos, neg = s[y == 1], s[y == 0]
    assert r.roc_auc == pytest.approx(((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()))
    ap, cuts = 0.0, sorted(set(s), reverse=True)
    for t in cuts:
        ap += ((s == t) & (y == 1)).sum() / (y == 1).sum() * (y[s >= t] == 1).mean()
    assert r.average_precision == pytest.approx(ap)
    best = min(t for t in cuts if (neg >= t).mean() <= 0.1)
    assert r.threshold == best and r.recall == pytest.approx((pos >= best).mean()) and r.fpr == pytest.approx((neg >= best).mean())
    b = metrics.dollar_budget(df, budget=0.2).first()
    within = [t for t in cuts if a[(s >= t) & (y == 0)].sum() <= 0.2 * a[y == 0].sum()]
    assert b.threshold == min(within) and b.fraud_dollar_recall == pytest.approx(a[(s >= b.threshold) & (y == 1)].sum() / a[y == 1].sum())
    assert metrics.dollar_budget(df, budget=-1.0).first().threshold == float("inf")
    t = metrics.at_threshold(df, 0.5).first()
    assert t.recall == pytest.approx((pos >= 0.5).mean()) and t.legit_dollar_share == pytest.approx(a[(s >= 0.5) & (y == 0)].sum() / a[y == 0].sum())
    assert metrics.brier(df, "score").first()[0] == pytest.approx(((s - y) ** 2).mean())
    order = np.argsort(s, kind="stable")
    bins = np.array_split(order, 7)
    got = {x.bin: x for x in metrics.reliability_by_mass(df, "score", bins=7).collect()}
    assert [got[i].n for i in range(7)] == [len(i) for i in bins] and got[3].mean_p == pytest.approx(s[bins[3]].mean())
    wide = metrics.reliability(df, "score")
    assert metrics.calibration_error(wide).first()[0] == pytest.approx(sum(x.n / n * abs(x.mean_p - x.rate) for x in wide.collect()))
