from __future__ import annotations

import math
import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import compare, metrics, model, training
from tidemark.plans.rulecheck import main


def rows(spark, n=600):
    rng = random.Random(1)
    data = []
    for i in range(n):
        fraud = int(rng.random() < 0.3)
        data.append((i, rng.gauss(30 + 60 * fraud, 20) if rng.random() < 0.9 else None, rng.choice("ab" if fraud else "bc"), fraud))
    return spark.createDataFrame(data, "id int, amount double, product_code string, fraud int")


def test_baseline_and_calibration(spark):
    df = rows(spark)
    baseline = training.Baseline(["amount"], ["product_code"]).fit(df)
    out = baseline.predict(df.withColumn("extra", df["id"]))
    assert out.columns == [*df.columns, "extra", "p"] and metrics.ranking(out, "p").first().roc_auc > 0.85
    c = training.fit_isotonic(df, "amount")
    assert list(c.x) == sorted(set(c.x)) and list(c.y) == sorted(c.y) and 0 <= c.y[0] <= c.y[-1] <= 1


def test_trained_trees_can_be_stored_and_scored(spark):
    df = rows(spark)
    train, valid = df.filter("id % 3 > 0"), df.filter("id % 3 = 0")
    trees, chosen = training.boosted(train, valid, ["amount"], grid=({"maxDepth": 1, "stepSize": 0.1}, {"maxDepth": 2, "stepSize": 0.3}), rounds=40)
    # stopped before the last round, as the loss on the other rows fell no more
    assert chosen["average_precision"] > 0.4 and 0 < chosen["trees"] == len(trees.trees) < 40
    again = model.parse_model(model.model_text(trees))
    out = model.score(valid.withColumn("amount", F.when(F.col("id") % 5 > 0, F.col("amount"))), again, {}, model.Calibrator((-9.0, 9.0), (0.0, 1.0)), contributions=True).collect()
    assert all(abs(r.raw_score - r.bias - sum(r.contributions)) < 1e-9 for r in out)
    assert metrics.ranking(model.score(valid, again, {}, model.Calibrator((-9.0, 9.0), (0.0, 1.0))), "raw_score").first().average_precision == pytest.approx(chosen["average_precision"])


def test_trees_score_as_trained(spark):
    df = rows(spark).withColumn("distance", (F.col("id") * 7 % 11).cast("double")).withColumn("fraud", F.col("fraud").cast("double"))
    x = VectorAssembler(inputCols=["amount", "distance"], outputCol="x").transform(df.fillna(training.MISSING, subset=["amount"]))
    trained = GBTClassifier(featuresCol="x", labelCol="fraud", maxIter=5, maxDepth=3, seed=1).fit(x)
    want = {r.id: r.p for r in trained.transform(x).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    got = df.select("id", "amount", "distance").toPandas()
    raw = training.as_model(trained, ["amount", "distance"]).raw(got[["amount", "distance"]].to_numpy())
    assert all(want[i] == pytest.approx(1 / (1 + math.exp(-r)), abs=1e-12) for i, r in zip(got["id"], raw, strict=True))
    assert got["amount"].isna().any()


def test_lock(tmp_path):
    lock = training.TestLock(str(tmp_path / "lock"))
    lock.open({"a": 1}, "d")
    lock.open({"a": 1}, "d")
    with pytest.raises(PermissionError):
        lock.open({"a": 2}, "d")


def test_coverage(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 0.5)], "id int, p double")
    assert compare.covered(a.filter("id = 1"), b).first().p == 0.5
    with pytest.raises(Exception, match="no prediction for 2"):
        compare.covered(a, b).collect()


def test_rulecheck(tmp_path, capsys):
    (tmp_path / "r").write_text("block  if :amount: > 1.0\n")
    assert main([str(tmp_path / "r"), "--format"]) == 0 and capsys.readouterr().out == "block if :amount: > 1\n"
    (tmp_path / "r").write_text("block if :amunt: > 1\n")
    assert main([str(tmp_path / "r")]) == 1 and ":amount:" in capsys.readouterr().out
