"""Recency alone, and how often payments with sketched features are shuffled."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_velocity import frame, history

from tidemark.functions.values import milli
from tidemark.operators import sketches, velocity


@pytest.mark.parametrize("chunk", [None, 60])
def test_recency_alone(spark, chunk):
    names = ["device_seconds_since_first", "device_seconds_since_last"]
    df = frame(spark, history(60, 3))
    want = sorted(map(str, velocity.features(df, ("device",)).select("id", *names).collect()))
    made = velocity.entity_features(df.withColumns({"_milli": milli(F.col("amount")), "_real": F.lit(1).cast("bigint")}), "device", (), chunk=chunk)
    assert sorted(map(str, made.select("id", *names).collect())) == want
    assert not [c for c in made.columns if "txn_count" in c or "distinct" in c]


def test_payments_are_dealt_by_their_place_once(spark):
    df = sketches.features(frame(spark, history(20, 3)), ("card", "device"))
    lines = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(id" in x]
    # three groups of estimates, and the payments
    assert len(lines) == 4
