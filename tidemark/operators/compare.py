"""Tables against each other: feature errors, parity by id, skew of keys, arrival order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import percentiles


#: Parts of one in which a mean's gaps are summed, and the gap from which doubles have no fractions.
PARTS, WHOLE = 1 << 30, float(1 << 53)


def exact_mean(gap: Column) -> Column:
    """The mean of numbers that aren't negative, each to the nearest of PARTS to one, whatever the order of rows: sums of doubles depend on it.

    Whole parts and fractions are summed apart as whole numbers, and those from WHOLE on, infinite or NaN as doubles.
    """
    small = F.when(gap < WHOLE, gap)
    whole = F.sum(F.floor(small).cast("decimal(38,0)"))
    rest = F.sum(F.floor((small - F.floor(small)) * PARTS + 0.5).cast("bigint"))
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    return F.try_divide(zero(whole) + zero(rest) / PARTS + zero(F.sum(F.when(gap >= WHOLE, gap))), F.count(gap))


def feature_errors(reference: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column of two tables joined by id: rows, missing_mismatch, exact, mean_abs, max_abs, mean_rel, over, under.

    mean_abs and mean_rel are exact means over rows where both are present; mean_rel over those whose reference isn't 0.
    """
    a = reference.select("id", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = other.select("id", *[F.col(c).alias(f"b_{c}") for c in columns])
    both = a.join(b, "id")
    aggs = []
    for i, c in enumerate(columns):
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        gap = F.abs(y - x)
        aggs += [F.count_if(x.isNull() != y.isNull()).alias(f"m{i}"), F.count_if(x.eqNullSafe(y)).alias(f"e{i}"), exact_mean(gap).alias(f"g{i}"), F.max(gap).alias(f"x{i}"),
                 exact_mean(F.when(x != 0, gap / F.abs(x))).alias(f"r{i}"), F.count_if(y > x).alias(f"o{i}"), F.count_if(y < x).alias(f"u{i}")]
    total = both.agg(F.count("*").alias("rows"), *aggs)
    names = {"m": "missing_mismatch", "e": "exact", "g": "mean_abs", "x": "max_abs", "r": "mean_rel", "o": "over", "u": "under"}
    rows = [F.struct(F.lit(c).alias("feature"), F.col("rows"), *[F.col(f"{k}{i}").alias(n) for k, n in names.items()]) for i, c in enumerate(columns)]
    return total.select(F.inline(F.array(*rows)))


def by_family(errors: DataFrame) -> DataFrame:
    """feature_errors summed over features of a family: counts, sums, means, ratios, recency, distinct."""
    f = F.col("feature")
    family = (
        F.when(f.contains("txn_count"), "count").when(f.contains("amount_sum"), "sum").when(f.contains("mean_amount"), "mean")
        .when(f.contains("amount_ratio"), "ratio").when(f.contains("distinct"), "distinct").otherwise("recency")
    )
    return errors.groupBy(family.alias("family")).agg(*[F.sum(c).alias(c) for c in ("rows", "missing_mismatch", "exact", "over", "under")], F.max("max_abs").alias("max_abs"))


def parity(left: DataFrame, right: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """(side, n) for rows on one side only, and (column, n) for values that differ where both have the row; missing equals missing."""
    a = left.select(key, F.lit(True).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = right.select(key, F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    both = a.join(b, key, "full_outer")
    matched = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    aggs = [F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"), F.count_if(matched).alias("both")]
    aggs += [F.count_if(matched & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"d_{c}") for c in columns]
    rows = [F.struct(F.lit(n).alias("what"), F.col(n).alias("n")) for n in ("only_left", "only_right", "both")]
    rows += [F.struct(F.lit(f"differs:{c}").alias("what"), F.col(f"d_{c}").alias("n")) for c in columns]
    return both.agg(*aggs).select(F.inline(F.array(*rows)))


def score_parity(left: DataFrame, right: DataFrame, column: str, key: str = "id") -> DataFrame:
    """(rows, identical, max_diff) of one number in two tables."""
    j = left.select(key, F.col(column).alias("a")).join(right.select(key, F.col(column).alias("b")), key)
    return j.agg(F.count("*").alias("rows"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("identical"), F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)).alias("max_diff"))


def key_skew(events: DataFrame, key: str, partitions: int, place=None) -> DataFrame:
    """(part, events, share_of_mean): how many events each of `partitions` would get. place: a column from the key, else its hash."""
    place = F.pmod(F.xxhash64(key), F.lit(partitions)) if place is None else place
    by = events.filter(F.col(key).isNotNull()).groupBy(place.cast("int").alias("part")).agg(F.count("*").alias("events"))
    mean = by.agg((F.sum("events") / partitions).alias("_mean"))
    return by.join(F.broadcast(mean)).select("part", "events", (F.col("events") / F.col("_mean")).alias("share_of_mean"))


def top_keys(events: DataFrame, key: str, k: int = 5) -> DataFrame:
    return events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("events")).orderBy(F.desc("events"), key).limit(k)


def latency_windows(log: DataFrame, at: str, latency: str, seconds: int = 5) -> DataFrame:
    """(start, n, p50, p99, p999, worst) of a latency over windows of `seconds`, exact percentiles."""
    timed = log.select((F.floor(F.col(at) / seconds) * seconds).alias("start"), F.col(latency).alias("_v"))
    whole = timed.groupBy("start").agg(F.count("*").alias("n"), F.max("_v").alias("worst"))
    ranked = percentiles(timed, "start", "_v", (0.5, 0.99, 0.999))
    return whole.join(ranked, "start", "left").select("start", "n", *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("p50", "p99", "p999"))], "worst")


def order_control(exact: DataFrame, parted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, wrong_rows): how many rows differ in any of the columns, as when each partition only sees its own cards."""
    j = exact.select("id", F.struct(*columns).alias("a")).join(parted.select("id", F.struct(*columns).alias("b")), "id")
    return j.agg(F.count("*").alias("rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("wrong_rows"))


def covered(rows: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """rows with the columns of predictions; a row without prediction fails the job."""
    joined = rows.join(predictions.withColumn("_there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string"))).cast(rows.schema[key].dataType)
    return joined.withColumn(key, F.when(F.col("_there"), F.col(key)).otherwise(missing)).drop("_there")
