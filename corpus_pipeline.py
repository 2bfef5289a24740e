"""A corpus from documents: five stages, each on what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents. Columns of documents that a stage doesn't name
pass through it whatever their names; of no rows, a stage makes none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, mixing, near_dup, pii, toxicity
from tidemark.llm.common import scratch_dir, stored, table

#: Decisions of a learned lexicon and a learned tagger can't be written in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon does not call toxic. Rows without id are judged as others, those without text are clean; repeated rows share a verdict."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates at 0.8 of five-word shingles.

    Five words are what stages on shingles take; op5's four are its contract's. Rows
    without id or without words all stay; of rows that repeat an id and text, one does.
    """
    return near_dup.drop_near_duplicates(docs, size=5)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars to match. Null texts stay null; every row stays."""
    return pii.redact_documents(docs, pii.train(pii.sample_texts(docs)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts that bring the sources to their targets, in random order.

    A null source is one of its own; rows without id are drawn by their text, rows that repeat both alike.
    """
    return mixing.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and whether they decode to the text's bytes, for every row; a null text has no tokens."""
    done = byte_bpe.round_trip(docs, carry=True)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return done.select("doc_id", "source", "lang", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("near_dup", one_of_each), ("pii", redact), ("mixing", mix), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared scratch folder."""
    folder = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return docs
