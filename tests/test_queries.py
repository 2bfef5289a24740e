"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark.plans import flows  # noqa: F401
from tidemark.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind here; the driver compares all of them.
CHOSEN = ["velocity_exact", "velocity_ties", "velocity_bucketed", "rule_expressions", "decide", "rule_stats", "backtest_block", "overlaps_block", "samples_allow", "sweep_given_current", "label_delay",
          "model_score", "ranking_metrics", "dollar_budget", "reliability_by_mass", "encoded", "dispute_upsert", "label_overlay", "decoded_payments", "decision_set", "audit_report",
          "csv_payments", "saved_table", "export_by_split", "encoded_by_table", "decision_log_scan", "audit_versions", "signed_deliveries", "backtest_label_time", "rule_problems", "rule_words", "rule_canonical", "rule_warnings", "rule_carets", "rule_versions", "arrived_within", "rule_suggestions", "catalog", "model_parts", "model_reasons",
          "routed_keys", "stream_decisions", "stream_once", "stream_labels", "decisions_in_order", "topic_records", "synthetic_table", "rules_over_edges", "velocity_hot_key", "velocity_hot_week", "velocity_late", "stream_late", "stored_answers", "long_lists", "sketch_distinct_cards", "features_as_of_hot_keys", "medians", "latency_windows"]


def normal(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        return f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


def compare(spark, query, sql) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = query(spark, str(DATA)).toPandas(), con.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert normal(got, columns) == normal(want, columns)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_against_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def test_synthetic_payments_are_all_made(spark):
    assert QUERIES["synthetic_payments"](spark, str(DATA)).count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def test_names():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
