"""Outcomes of payments from dispute events: upserts, labels, overlays.

Events: event_id, type (a success, a dispute created or closed), created
(Unix seconds), payment_id, dispute_id, reason, status, amount, seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.payments import EPOCH

SUCCEEDED, CREATED, CLOSED = "payment_intent.succeeded", "charge.dispute.created", "charge.dispute.closed"
FRAUDULENT = "fraudulent"


def dispute_states(events: DataFrame) -> DataFrame:
    """One row per (payment_id, dispute_id) as its latest event left it.

    The latest is by created; of events in the same second one that closes
    wins, and then the one that came last (seq). Once closed, closed.
    """
    closes = F.col("type") == CLOSED
    order = F.struct("created", closes.cast("int"), "seq")
    last = F.max_by(F.struct("reason", "status", "amount", "created"), order).alias("x")
    disputes = events.filter(F.col("type").isin(CREATED, CLOSED)).groupBy("payment_id", "dispute_id").agg(last, F.bool_or(closes).alias("seen_closed"))
    return disputes.select("payment_id", "dispute_id", "x.reason", "x.status", "x.amount", F.col("x.created").alias("updated"), F.col("seen_closed").alias("closed"))


def upsert(states: DataFrame, events: DataFrame) -> DataFrame:
    """states after more events, as if all had come at once. For foreachBatch over a label stream."""
    known = states.select(
        F.when(F.col("closed"), CLOSED).otherwise(CREATED).alias("type"), F.col("updated").alias("created"), "payment_id", "dispute_id", "reason", "status", "amount", F.lit(-1).cast("bigint").alias("seq")
    )
    return dispute_states(known.unionByName(events.select(*known.columns)))


def payment_labels(states: DataFrame) -> DataFrame:
    """(payment_id, label): 1 if a fraudulent dispute was not won, 0 if all were closed as won, else -1."""
    fraud = F.col("reason") == FRAUDULENT
    won = F.col("closed") & (F.col("status") == "won")
    lost = F.coalesce(F.bool_or(fraud & ~F.coalesce(won, F.lit(False))), F.lit(False))
    some = F.coalesce(F.bool_or(fraud), F.lit(False))
    return states.groupBy("payment_id").agg(F.when(lost, 1).when(some, 0).otherwise(-1).cast("tinyint").alias("label"))


def label_counts(events: DataFrame) -> DataFrame:
    """(payments, succeeded, fraud, legit, disputes, closed_disputes) of a label log."""
    states = dispute_states(events)
    paid = events.groupBy("payment_id").agg(F.bool_or(F.col("type") == SUCCEEDED).alias("ok"))
    a = paid.agg(F.count("*").alias("payments"), F.count_if("ok").alias("succeeded"))
    b = payment_labels(states).agg(F.count_if(F.col("label") == 1).alias("fraud"), F.count_if(F.col("label") == 0).alias("legit"))
    c = states.agg(F.count("*").alias("disputes"), F.count_if("closed").alias("closed_disputes"))
    # three rows of one, each an aggregate without keys
    return a.join(F.broadcast(b)).join(F.broadcast(c))


def payment_number(payment_id: str | Column) -> Column:
    """The id of a payment named txn_<id>; null for any other name."""
    c = F.col(payment_id) if isinstance(payment_id, str) else payment_id
    return F.when(F.startswith(c, F.lit("txn_")), F.substring(c, 5, 30).try_cast("bigint"))


def overlay(table: DataFrame, labels: DataFrame) -> DataFrame:
    """table with fraud replaced where labels (payment_id, label) knows better; unknown labels change nothing."""
    known = labels.filter("label <> -1").select(payment_number("payment_id").alias("id"), F.col("label").alias("_label")).filter("id IS NOT NULL")
    return table.join(known, "id", "left").withColumn("fraud", F.coalesce("_label", "fraud").cast("tinyint")).drop("_label").select(*table.columns)


def first_disputes(events: DataFrame) -> DataFrame:
    """(payment_id, arrived_dt): when the first fraudulent dispute of each payment was opened."""
    opened = events.filter((F.col("type") == CREATED) & (F.col("reason") == FRAUDULENT) & (F.coalesce("payment_id", F.lit("")) != ""))
    return opened.groupBy("payment_id").agg((F.min("created") - EPOCH).alias("arrived_dt"))


def label_by_disputes(table: DataFrame, disputes: DataFrame) -> DataFrame:
    """table with fraud and label_time by first_disputes: a payment without one is legitimate, its label never comes."""
    known = disputes.select(payment_number("payment_id").alias("id"), "arrived_dt")
    out = table.drop("fraud", "label_time").join(known, "id", "left")
    return out.withColumns({"fraud": F.col("arrived_dt").isNotNull().cast("tinyint"), "label_time": F.col("arrived_dt")}).drop("arrived_dt").select(*table.columns)
