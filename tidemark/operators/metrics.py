"""Ranking, cost and calibration figures of scores against labels.

Rows are grouped by score before anything is put in order, so ties fall
together and what is ordered is one row per distinct score. Running sums over
those are taken in two steps, within ranges of scores and over the ranges, so
that no task holds all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.scratch import scratch_dir, stored

#: Ranges of scores whose sums are taken apart.
RANGES = 64


def tie_groups(df: DataFrame, score: str = "score", label: str = "fraud", amount: str | None = None) -> DataFrame:
    """(s, p, n, pm, nm): per distinct score frauds, others, and their thousandths. Rows without score or label 0 or 1 are left out."""
    milli = F.coalesce(F.round(F.col(amount) * 1000), F.lit(0.0)).cast("bigint") if amount else F.lit(0).cast("bigint")
    yes = F.col(label) == 1
    return df.filter(F.col(score).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(score).alias("s")).agg(
        F.count_if(yes).alias("p"), F.count_if(~yes).alias("n"), F.sum(F.when(yes, milli).otherwise(0)).alias("pm"), F.sum(F.when(~yes, milli).otherwise(0)).alias("nm")
    )


def _cuts(of: Column | str) -> Column:
    """Values that part a column into some RANGES ranges with about equally many rows: as many as there are, whatever the rows."""
    return F.array_distinct(F.percentile_approx(of, [k / RANGES for k in range(1, RANGES)], 10 * RANGES))


def _once(cuts: DataFrame) -> DataFrame:
    """cuts, worked out once: they depend on the order in which tasks come, and all that is parted by them must be parted alike."""
    return stored(cuts, scratch_dir(cuts.sparkSession), "cuts")


def _range(value: Column, cuts: Column) -> Column:
    """The range that value lies in: odd where it is one of the cuts, which a value with very many rows is."""
    return F.aggregate(cuts, F.lit(0), lambda a, c: a + F.when(value > c, 2).when(value == c, 1).otherwise(0))


def cumulative(groups: DataFrame, columns: tuple[str, ...] = ("p", "n", "pm", "nm")) -> DataFrame:
    """groups with c_<column>: sums from the highest score down to each, and t_<column>, the totals."""
    whole = _once(groups.agg(_cuts("s").alias("_cuts"), *[F.sum(c).alias(f"t_{c}") for c in columns]))
    # one row, the result of an aggregate without keys
    df = groups.join(F.broadcast(whole)).withColumn("_r", _range(F.col("s"), F.col("_cuts")))
    parts = df.groupBy("_r").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    above = W.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_r", *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"a_{c}") for c in columns])
    down = W.partitionBy("_r").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    df = df.join(F.broadcast(parts), "_r")
    return df.withColumns({f"c_{c}": F.col(f"a_{c}") + F.sum(c).over(down) for c in columns}).drop("_r", "_cuts", *[f"a_{c}" for c in columns])


def percentiles(values: DataFrame, by: str, value: str, q: Sequence[float]) -> DataFrame:
    """(by, p): for each group the exact percentiles at q, linear between two values, as an array.

    Rows are counted per value first; values are then ranked within ranges that
    approximate cuts part evenly, so that no task holds all values of a group.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    whole = _once(counts.groupBy(by).agg(_cuts("v").alias("_cuts"), F.sum("n").alias("_t")))
    df = counts.join(whole, by).withColumn("_r", _range(F.col("v"), F.col("_cuts")))
    parts = df.groupBy(by, "_r").agg(F.sum("n").alias("_m"))
    below = W.partitionBy(by).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(by, "_r", F.coalesce(F.sum("_m").over(below), F.lit(0)).alias("_below"))
    inside = W.partitionBy(by, "_r").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    df = df.join(parts, [by, "_r"]).withColumn("_at", F.col("_below") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    aggs = []
    for k, x in enumerate(q):
        place = (F.col("_t") - 1) * F.lit(float(x))
        holds = lambda i: (F.col("_at") <= i) & (i < F.col("_at") + F.col("n"))
        aggs += [F.max(F.when(holds(F.floor(place)), F.col("v"))).alias(f"_lo{k}"), F.max(F.when(holds(F.ceil(place)), F.col("v"))).alias(f"_hi{k}"), F.max(place - F.floor(place)).alias(f"_f{k}")]
    done = df.groupBy(by).agg(*aggs)
    at = lambda k: F.when(F.col(f"_f{k}") == 0, F.col(f"_lo{k}")).otherwise((1 - F.col(f"_f{k}")) * F.col(f"_lo{k}") + F.col(f"_f{k}") * F.col(f"_hi{k}"))
    return done.select(by, F.array(*[at(k) for k in range(len(q))]).alias("p"))


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def ranking(df: DataFrame, score: str = "score", label: str = "fraud", fpr: float = 0.01) -> DataFrame:
    """(roc_auc, average_precision, threshold, recall, fpr): the area with ties as one step, the mean precision,
    and the lowest threshold whose false-positive rate is at most fpr (infinite if none is)."""
    c = cumulative(tie_groups(df, score, label), ("p", "n"))
    before_p, before_n = F.col("c_p") - F.col("p"), F.col("c_n") - F.col("n")
    # twice the trapezoid, in whole numbers
    area = F.sum(((F.col("c_n") - before_n) * (F.col("c_p") + before_p)).cast("decimal(38,0)"))
    precision = F.sum(F.try_divide(_d("p"), _d("t_p")) * _d("c_p") / _d(F.col("c_p") + F.col("c_n")))
    within = _d("c_n") <= fpr * _d("t_n")
    best = F.max_by(F.struct("s", "c_p", "c_n"), F.when(within, F.col("c_p") + F.col("c_n")))
    t = c.agg(area.alias("a"), precision.alias("ap"), best.alias("b"), F.max("t_p").alias("tp"), F.max("t_n").alias("tn"))
    return t.select(
        F.try_divide(_d("a"), 2.0 * _d("tp") * _d("tn")).alias("roc_auc"), F.col("ap").alias("average_precision"),
        F.coalesce(F.col("b.s"), F.lit(float("inf"))).alias("threshold"), F.try_divide(F.coalesce(_d("b.c_p"), F.lit(0.0)), _d("tp")).alias("recall"),
        F.try_divide(F.coalesce(_d("b.c_n"), F.lit(0.0)), _d("tn")).alias("fpr"),
    )


def dollar_budget(df: DataFrame, score: str = "score", label: str = "fraud", amount: str = "amount", budget: float = 0.01) -> DataFrame:
    """(threshold, fraud_dollar_recall, legit_dollar_share): block from the riskiest tie group down while legitimate dollars stay within budget."""
    c = cumulative(tie_groups(df, score, label, amount))
    best = F.max_by(F.struct("s", "c_pm", "c_nm"), F.when(_d("c_nm") <= budget * _d("t_nm"), -F.col("s")))
    t = c.agg(best.alias("b"), F.max("t_pm").alias("tp"), F.max("t_nm").alias("tn"))
    return t.select(F.coalesce(F.col("b.s"), F.lit(float("inf"))).alias("threshold"), F.coalesce(F.try_divide(_d("b.c_pm"), _d("tp")), F.lit(0.0)).alias("fraud_dollar_recall"), F.coalesce(F.try_divide(_d("b.c_nm"), _d("tn")), F.lit(0.0)).alias("legit_dollar_share"))


def at_threshold(df: DataFrame, threshold: float, score: str = "score", label: str = "fraud", amount: str = "amount") -> DataFrame:
    """(recall, fpr, fraud_dollar_recall, legit_dollar_share) of flagging score >= threshold."""
    g = tie_groups(df, score, label, amount)
    over = F.col("s") >= threshold
    part = lambda c: F.try_divide(_d(F.coalesce(F.sum(F.when(over, F.col(c))), F.lit(0))), _d(F.sum(c)))
    return g.agg(part("p").alias("recall"), part("n").alias("fpr"), part("pm").alias("fraud_dollar_recall"), part("nm").alias("legit_dollar_share"))


def brier(df: DataFrame, p: str = "p", label: str = "fraud") -> DataFrame:
    gap = F.col(p) - F.col(label)
    return df.filter(F.col(label).isin(0, 1)).agg(F.avg(gap * gap).alias("brier"))


def reliability(df: DataFrame, p: str = "p", label: str = "fraud", bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate) of bins of equal width over [0, 1]; empty bins are absent."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.filter(F.col(label).isin(0, 1)).groupBy(b).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("rate"))


def reliability_by_mass(df: DataFrame, p: str = "p", label: str = "fraud", bins: int = 20, order: str = "id") -> DataFrame:
    """(bin, n, mean_p, rate) of bins with equally many rows, by p and then `order`; the first bins take what is left over.

    A row's place is its place within its range of p, and where one p has very
    many rows its range of `order`, plus the rows of lower ranges; so ranks are
    exact and no task ranks all rows.
    """
    df = df.filter(F.col(label).isin(0, 1) & F.col(p).isNotNull()).select(F.col(p).alias("p_"), F.col(label).cast("double").alias("y_"), F.col(order).alias("o_"))
    df = df.join(F.broadcast(_once(df.agg(_cuts("p_").alias("_cuts"))))).withColumn("_r", _range(F.col("p_"), F.col("_cuts"))).drop("_cuts")
    ties = _once(df.filter("_r % 2 = 1").groupBy("_r").agg(_cuts("o_").alias("_cuts")))
    df = df.join(F.broadcast(ties), "_r", "left").withColumn("_q", F.coalesce(_range(F.col("o_"), F.col("_cuts")), F.lit(0))).drop("_cuts")
    sizes = df.groupBy("_r", "_q").agg(F.count("*").alias("_n"))
    below, all_ = W.orderBy("_r", "_q").rowsBetween(W.unboundedPreceding, -1), W.orderBy("_r", "_q").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sizes = sizes.select("_r", "_q", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"), F.sum("_n").over(all_).alias("_all"))
    df = df.join(F.broadcast(sizes), ["_r", "_q"])
    place = F.col("_below") + F.row_number().over(W.partitionBy("_r", "_q").orderBy("p_", "o_")) - 1
    size, more = F.floor(F.col("_all") / bins), F.col("_all") % bins
    head = more * (size + 1)
    b = F.when(place < head, F.floor(place / (size + 1))).otherwise(more + F.floor(F.try_divide(place - head, size)))
    df = df.withColumn("bin", b.cast("int"))
    return df.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p_").alias("mean_p"), F.avg("y_").alias("rate"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """(ece): the mean gap between predicted and seen rates of reliability's bins, by their rows."""
    return bins.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))), F.sum("n")).alias("ece"))


def score_histogram(df: DataFrame, score: str = "risk_score") -> DataFrame:
    return df.groupBy(score).agg(F.count("*").alias("n"))


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, p50): exact medians of the present values; null for a field without any."""
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in columns])))
    fields = df.sparkSession.createDataFrame([(c,) for c in columns], "field string")
    return fields.join(percentiles(each, "field", "x", (0.5,)), "field", "left").select("field", F.get("p", F.lit(0)).alias("p50"))
