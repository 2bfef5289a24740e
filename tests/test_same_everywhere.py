"""Results that must not depend on the order of rows, on where tasks run, or on how rows come in blocks."""

from __future__ import annotations

import math
import random
from fractions import Fraction
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import compare, metrics
from tidemark.plans import flows  # noqa: F401
from tidemark.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.01")


def exactly(spark, name, folder=DATA):
    """Rows of the query and of its SQL, to the last digit."""
    con = duckdb.connect()
    for t in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    return sorted(map(repr, map(tuple, QUERIES[name](spark, str(folder)).select(*names).collect()))), sorted(map(repr, want.fetchall()))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["latency_windows", "medians"])
def test_percentiles_to_the_last_digit(spark, name):
    got, want = exactly(spark, name)
    assert got == want


def test_cuts_are_worked_out_once(spark):
    """Approximate cuts may differ each time; the ranges and the sums below them must be parted by the same ones."""
    df = spark.range(1_000).select("id", (F.col("id") % 7).alias("g"), (F.col("id") * 0.37 % 1).alias("score"), (F.col("id") % 2).alias("fraud"), F.lit(1.5).alias("amount"))
    done = [metrics.percentiles(df, "g", "score", (0.5,)), metrics.medians(df, ["score"]), metrics.cumulative(metrics.tie_groups(df)), metrics.reliability_by_mass(df, "score")]
    for d in done:
        assert "percentile_approx" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_means_of_gaps_do_not_depend_on_the_order(spark):
    rng = random.Random(5)
    gaps = [rng.choice([rng.random() * 1e-3, rng.random() * 1e7, 0.1, 3.0]) for _ in range(5_000)]
    want = float(sum(Fraction(math.floor(g)) + Fraction(math.floor((g - math.floor(g)) * compare.PARTS + 0.5), compare.PARTS) for g in gaps) / len(gaps))
    got = set()
    for _ in range(3):
        rng.shuffle(gaps)
        got.add(spark.createDataFrame([(g,) for g in gaps], "g double").repartition(3).agg(compare.exact_mean(F.col("g"))).first()[0])
    assert len(got) == 1 and got.pop() == pytest.approx(want, rel=1e-14)
    odd = spark.createDataFrame([(1.5,), (None,), (2.0**60,), (float("inf"),)], "g double")
    assert odd.agg(compare.exact_mean(F.col("g"))).first()[0] == float("inf") and odd.filter("g < 9").agg(compare.exact_mean(F.col("g"))).first()[0] == 1.5 and odd.filter("g IS NULL").agg(compare.exact_mean(F.col("g"))).first()[0] is None


def test_errors_are_by_exact_means(spark):
    a = spark.createDataFrame([(i, 0.1 * i) for i in range(9)], "id int, x double")
    plan = compare.feature_errors(a, a, ["x"])._jdf.queryExecution().analyzed().toString()
    assert "avg(" not in plan
