"""Lines that recur over many documents, by levelled sorted runs of line hashes.

Documents come in batches, the largest ids first. A batch's keys, with how many
of its documents hold them, are merge-anti-joined with the runs of the batches
before it, as left joins that mark what a run has: a key without any mark is
fresh, and the batch's largest document that holds it owns it. The batch's keys,
fresh ones with their owner, then become a run of their own. A level that holds
FANOUT runs is compacted into one of the next, so few runs are ever read. Runs
are tables bucketed and sorted by key: joins with them move none of their rows.

Only built-in functions on whole tables; no Python workers.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, hot_join, lower_ascii, scratch_dir, stored, table, unused
from tidemark.session import session_like

#: A key shorter than this many code points is never dropped, nor is one found in fewer documents.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Batches that a table is cut into by doc_id, and runs of a level that are compacted into one.
BATCHES, FANOUT = 8, 4
#: A run's buckets are so many that all batches put no more than about this many rows in one, but never more than a shuffle's partitions.
BUCKET_ROWS = 250_000


class LineRuns:
    """Runs of (key, n, owner): of a batch or several, how many documents hold a key, and who owns it if no earlier run had it.

    Runs are Parquet tables in folder, bucketed by key, as many buckets as a
    shuffle has partitions; so a batch's own keys are dealt out once and written
    from there. The tables' names in the session's catalog go once they have been
    compacted, and with close().
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame) -> str:
        name = f"tidemark_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")  # the catalog's entry; a table with a path of its own keeps its files

    def _rows(self, names: list[str]) -> DataFrame:
        # by their files and not as tables: a union of bucketed tables counts as if still dealt by key, which it isn't
        schema = self.spark.table(names[0]).schema
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{name}" for name in names])

    @property
    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, pairs: DataFrame) -> None:
        """Take a batch of (key, doc_id), each pair once: its keys become a run."""
        df, seen = pairs.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("owner")), F.lit(False)
        for i, name in enumerate(self.names):  # a key stands once in a run
            df = df.join(self.spark.table(name).select("key", F.lit(True).alias(f"in_{i}")), "key", "left")
            seen = seen | F.col(f"in_{i}").isNotNull()
        self._keep(self._write(df.select("key", "n", F.when(~seen, F.col("owner")).alias("owner"))), 0)

    def _keep(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        runs = self.levels[level]
        runs.append(run)
        if len(runs) == self.fanout:
            merged = self._write(_merged(self._rows(runs)))
            for name in runs:
                self._drop(name)
            self.levels[level] = []
            self._keep(merged, level + 1)

    def totals(self) -> DataFrame:
        """(key, n, owner) over all batches."""
        return _merged(self._rows(self.names))

    def close(self) -> None:
        for name in self.names:
            self._drop(name)
        self.levels = []


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("owner").alias("owner"))


def lines_of(text: Column) -> Column:
    """The lines of a text; of none, one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _without(lines: Column, places: Column) -> Column:
    """lines without those at the sorted places: the stretches between them, one after the other."""
    at = F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))
    stretch = lambda j: F.slice(lines, F.get(at, j) + 2, F.get(at, j + 1) - F.get(at, j) - 1)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), stretch))


def line_keys(docs: DataFrame, text: str, doc_id: str, least_chars: int) -> DataFrame:
    """(key, doc_id, row, place): of each line of least_chars or more, the MD5 of what its contract calls a key, and where it stands.

    row tells rows of one doc_id with different texts apart.
    """
    spaces = F.lit(SPACES)
    lines = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    lines = lines.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.posexplode(lines_of(F.col(text))).alias("place", "line"))
    lines = lines.withColumn("line", F.btrim("line", spaces)).filter(F.char_length("line") >= least_chars)
    return lines.select(F.unhex(F.md5(lower_ascii(F.col("line")))).alias("key"), "doc_id", "row", "place")


def repeated_lines(lines: DataFrame, least_docs: int, batches: int, folder: str) -> DataFrame:
    """(key, n, owner) of keys in at least least_docs documents: the batches of lines go through the runs, the largest doc_id first."""
    spark = lines.sparkSession
    edges = lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    edges = sorted(set(edges or []))
    batch = reduce(Column.__add__, [(F.col("doc_id") <= e).cast("int") for e in edges], F.lit(0))
    pairs = lines.select("key", "doc_id").distinct().withColumn("batch", batch)
    path = f"{folder}/pairs"
    pairs.write.partitionBy("batch").parquet(path)
    # keys are few beside the texts that a session's partitions are meant for: a file for each of those would be tiny, and each file costs
    buckets = -(-spark.read.schema(pairs.schema).parquet(path).count() // BUCKET_ROWS)
    parts = "spark.sql.shuffle.partitions"
    own = session_like(spark, {parts: max(1, min(buckets, int(spark.conf.get(parts))))})
    pairs = own.read.schema(pairs.schema).parquet(path)
    runs = LineRuns(own, folder)
    for b in range(len(edges) + 1):
        runs.add(pairs.filter(F.col("batch") == b).drop("batch"))
    found = stored(runs.totals().filter(F.col("n") >= least_docs), folder, "repeated")
    runs.close()
    return spark.read.schema(found.schema).parquet(f"{folder}/repeated")


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: the text without lines that recur over documents.

    A line's key is the line without white space at its ends, A-Z in small
    letters. A key of at least least_chars code points that at least least_docs
    documents hold loses all its lines but those of the largest doc_id that has it.
    Rows of one doc_id are one document, and each loses its lines; a row that
    is there twice is twice in the result. Rows without doc_id have no place in
    the order: they don't count as documents and keep all lines. A null text is one empty line.
    All other columns stay, whatever their names; only n_lines, n_dropped and kept_text give way.
    Bytes that aren't UTF-8 stay in texts that lose no line, and may be U+FFFD in kept_text of others.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    folder = scratch_dir(docs.sparkSession)
    lines = stored(line_keys(docs, text, doc_id, least_chars), folder, "lines")
    hot = repeated_lines(lines, least_docs, batches, folder)
    id_, row, places = unused(docs.columns, "_id", "_row", "_places")
    gone = hot_join(lines, hot.select("key", "owner"), "key", ["doc_id", "row"], counts=hot.select("key", "n"))
    gone = gone.filter(F.col("doc_id") != F.col("owner")).groupBy(F.col("doc_id").alias(id_), F.col("row").alias(row)).agg(F.sort_array(F.collect_set("place")).alias(places))
    df = docs.withColumns({id_: F.col(doc_id), row: F.xxhash64(text)}).join(gone, [id_, row], "left")
    value, lost = F.coalesce(F.col(text), F.lit("")), F.col(places)
    kept = F.when(lost.isNull(), value).otherwise(F.array_join(_without(lines_of(F.col(text)), lost), "\n"))
    count = (F.char_length(value) - F.char_length(F.replace(value, F.lit("\n"))) + 1).cast("bigint")
    return df.withColumns({"n_lines": count, "n_dropped": F.coalesce(F.size(lost), F.lit(0)).cast("bigint"), "kept_text": kept}).drop(id_, row, places)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
