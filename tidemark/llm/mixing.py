"""Mixing sources to target weights by Poisson replication.

A source whose target share is r times its present share has every document
repeated r times in the mean: how often is drawn per document from a Poisson
distribution, by inverting it at a number hashed from the document's id. The
draw depends on nothing else, so any executor that repeats it gets the same.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hot_join, scratch_dir, stored, table, unused

#: Without given weights, a source's target is its share to this power.
TEMPERATURE = 0.5
SEED = "mix-1"
#: Up to so many sources (some 20 MB) the rates are broadcast, else joined by a shuffle that deals large sources to groups.
MAX_BROADCAST_SOURCES = 100_000
#: exp(-mean) of a larger mean would leave the range of doubles.
LARGEST_MEAN = 500


def unit(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 hash, alike in every engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**52)


def poisson(rate: Column, u: Column) -> Column:
    """The least k whose distribution function at mean `rate` is over u.

    Term k is term k - 1 times rate / k, from exp(-rate) on; the list of terms
    ends where what is left is under anything that 52 bits of u can tell.
    """
    last = (rate + 10 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(a: Column, j: Column) -> Column:
        p = a["p"] * rate / j
        return F.when(a["cdf"] > u, a).otherwise(F.struct(p.alias("p"), (a["cdf"] + p).alias("cdf"), j.alias("k")))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["k"])


def repetitions(rate: Column, seed: str, doc_id: Column) -> Column:
    """A Poisson count of mean `rate`; a large mean is a sum of smaller draws."""
    parts = F.greatest(F.ceil(rate / LARGEST_MEAN), F.lit(1)).cast("int")
    draws = F.transform(F.sequence(F.lit(1), parts), lambda i: poisson(rate / parts, unit(F.lit(seed), doc_id, i)))
    return F.aggregate(draws, F.lit(0), lambda a, x: a + x)


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, text: str = "text") -> DataFrame:
    """Per source: n_docs, n_chars and rate, the mean repetition that meets its weight.

    Shares are of characters. weights maps sources to target weights of any
    scale; a source without one gets none of the mixture. Without weights each
    target is the present share to the power TEMPERATURE. The total stays what
    it is. A source that holds no character at all keeps rate 1. A null source
    is "", repeated rows count each, other columns mean nothing, no rows give
    no sources.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars")
    )
    if weights is None:
        weight = F.pow(F.col("n_chars").cast("double"), F.lit(TEMPERATURE))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, float(w)).otherwise(weight)
    sizes = sizes.withColumn("_weight", weight)
    total = sizes.agg(F.sum("n_chars").cast("double").alias("_chars"), F.sum("_weight").alias("_weights"))
    rate = F.col("_weight") / F.col("_weights") * F.col("_chars") / F.col("n_chars")
    # total is one row, the result of an aggregate without keys
    return sizes.join(F.broadcast(total), F.lit(True)).select(
        "source", "n_docs", "n_chars", F.when(F.col("n_chars") == 0, 1.0).otherwise(rate).alias("rate")
    )


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: str = SEED, *, text: str = "text") -> DataFrame:
    """docs with each row repeated by its Poisson count, in a random order.

    Adds copy (from 0) and shuffle_key; other columns stay, and columns of docs
    with these names give way. Rows drawn 0 times do not appear. The order is
    random by partition and within it: rows go to partitions by shuffle_key,
    an MD5 number of seed, doc_id and copy, and are sorted by it there.

    A null source is a source of its own (""); null and empty texts count no
    characters but are drawn at their source's rate. A row without doc_id is
    drawn by a hash of its text. Rows that repeat both draw the same count.
    Other columns of docs stay, whatever their names. Empty input gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("copy", "shuffle_key")
    source, rate, id_, n = unused(docs.columns, "_source", "_rate", "_id", "_n")
    sizes = stored(source_rates(docs, weights, text), scratch_dir(spark), "rates")
    rates = sizes.select(F.col("source").alias(source), F.col("rate").alias(rate))
    unnamed = F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    docs = docs.withColumns({source: F.coalesce("source", F.lit("")), id_: F.coalesce(F.col("doc_id").cast("string"), unnamed)})
    if sizes.count() <= MAX_BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), source)
    else:
        joined = hot_join(docs, rates, source, by=id_, counts=sizes.select(F.col("source").alias(source), F.col("n_docs").alias("n")))
    drawn = joined.withColumn(n, repetitions(F.col(rate), seed, F.col(id_)))
    copies = drawn.filter(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    keyed = copies.withColumn("shuffle_key", unit(F.lit(seed), F.lit("order"), F.col(id_), F.col("copy"))).drop(source, rate, n, id_)
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
