"""Phrases that collocate, by passes of growing length with hashed bucket counts.

Pass k counts phrases of k words exactly and, on the way, counts phrases of
k + 1 words by bucket, a hash of the phrase. The buckets that reach the least
count become a bitmap, and so do the frequent phrases of k words. The next pass
counts a phrase only if its bucket's bit is set (no rarer bucket can hold a
frequent phrase) and the bits of both its parts without last and without first
word are (every part of a frequent phrase is frequent). From the second pass
on, only stretches of words in which a longer phrase is still possible are
written for the next pass, so the text shrinks quickly.

Bitmaps have a number of bits that is fixed before the first pass, MOST_BUCKETS
at most, whatever the corpus holds, so they may be broadcast. They only save
work: a bit set for nothing costs an exact count, and phrases below the least
count go after it.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm.common import SLICE_CHARS, hot_join, scratch_dir, stored, table
from tidemark.shipping import ship

#: Occurrences of a phrase, words of the longest, phrases of a language in the report.
LEAST, LONGEST, TOP = 100, 5, 2000
#: One bucket for about so many bytes of text, within bounds: at most 128 MB of counts in a task and bitmaps of 16 MB.
BYTES_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 20, 1 << 27
#: Buckets are summed in chunks, which are dealt out.
CHUNK = 1 << 13
#: Counted phrases that a task holds before it passes them on.
HELD = 100_000
#: Small letters, blanks between words, and line ends between pieces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10)
_MIX = np.uint64(0x9E3779B97F4A7C15)
COUNT, BUCKETS, TEXT = 0, 1, 2

_ROWS = StructType([StructField("kind", IntegerType()), StructField("lang", StringType()), StructField("phrase", StringType()), StructField("n", LongType()), StructField("chunk", IntegerType()), StructField("bytes", BinaryType())])


def tokens(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text in small letters, with a line end between pieces; empty strings are to be skipped."""
    return text.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")


def _joined(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more."""
    x = h * _MIX + more
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of texts of one language as numbers, in order; 1 stands between pieces."""

    def __init__(self, lang: str, text: bytes):
        index: dict[bytes, int] = defaultdict(count(2).__next__, {b"": 0, b"\n": 1})
        found = tokens(text)
        ids = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
        self.ids, self.names = ids[ids != 0], list(index)
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.names), np.uint64, len(self.names))
        self._hashes = [hashes[self.ids]]
        self._whole = [self.ids != 1]

    def hashes(self, length: int) -> np.ndarray:
        """Of the phrase of so many words at each place where one fits."""
        while len(self._hashes) < length:
            last, k = self._hashes[-1], len(self._hashes)
            self._hashes.append(_joined(last[:-1], self._hashes[0][k:]) if len(last) else last)
        return self._hashes[length - 1]

    def whole(self, length: int) -> np.ndarray:
        """Whether the phrase at each place lies within a piece."""
        while len(self._whole) < length:
            last, k = self._whole[-1], len(self._whole)
            self._whole.append(last[:-1] & self._whole[0][k:] if len(last) else last)
        return self._whole[length - 1]

    def phrase(self, place: int, length: int) -> bytes:
        return b" ".join([self.names[i] for i in self.ids[place : place + length].tolist()])

    def counted(self, places: np.ndarray, length: int) -> Iterator[tuple[bytes, int]]:
        """Each phrase at these places, with how often it is there; told apart by its words and not by hash."""
        if not len(places):
            return
        code = self.ids[places]
        for k in range(1, length):
            _, code = np.unique(code * len(self.names) + self.ids[places + k], return_inverse=True)
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        for i, c in zip(places[first].tolist(), n.tolist(), strict=True):
            yield self.phrase(i, length), c


def has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bits of these hashes are set."""
    at = h & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Buckets:
    """How often each bucket was met, up to `most`: beyond it a count doesn't matter."""

    def __init__(self, size: int, most: int):
        self.most = most
        self.n = np.zeros(size, np.uint8 if most < 128 else np.uint16 if most < 1 << 15 else np.uint64)

    def add(self, h: np.ndarray) -> None:
        at, n = np.unique(h & np.uint64(len(self.n) - 1), return_counts=True)
        at = at.astype(np.int64)
        self.n[at] = np.minimum(self.n[at] + np.minimum(n, self.most).astype(self.n.dtype), self.most)

    def chunks(self) -> Iterator[tuple[int, bytes]]:
        rows = self.n.reshape(-1, CHUNK)
        for i in np.flatnonzero(rows.any(axis=1)).tolist():
            yield i, zlib.compress(rows[i].tobytes(), 1)


def _slices(block: pa.RecordBatch) -> Iterator[dict[str, bytes]]:
    """The texts of a batch by language, in slices, with a line end between texts."""
    texts, size = defaultdict(list), 0
    for lang, text in zip(block.column(0).to_pylist(), block.column(1).cast(pa.binary()).to_pylist(), strict=True):
        if text:
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode("utf-8", "replace").encode()
            texts[lang].append(text)
            size += len(text)
        if size >= SLICE_CHARS:
            yield {k: b"\n".join(v) for k, v in texts.items()}
            texts, size = defaultdict(list), 0
    if texts:
        yield {k: b"\n".join(v) for k, v in texts.items()}


def _pass(length: int, longest: int, least: int, size: int, sieve: Callable[[], tuple[np.ndarray, np.ndarray]] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task of the pass does with its texts. sieve: the bitmaps of buckets and of frequent parts."""
    schema = to_arrow_schema(_ROWS)

    def rows(kind: int, lang: list, phrase: list, n: list, chunk: list | None = None, data: list | None = None) -> pa.RecordBatch:
        many = max(len(lang), len(chunk or ()))
        empty = [None] * many
        columns = ([kind] * many, lang or empty, phrase or empty, n or empty, chunk or empty, data or empty)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def held(tally: dict[tuple[str, bytes], int]) -> pa.RecordBatch:
        out = rows(COUNT, [k[0] for k in tally], [k[1].decode() for k in tally], list(tally.values()))
        tally.clear()
        return out

    def task(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[tuple[str, bytes], int] = defaultdict(int)
        buckets = Buckets(size, least) if length < longest else None
        bits, parts = sieve() if sieve else (None, None)
        for block in blocks:
            for texts in _slices(block):
                left: dict[str, bytes] = {}
                for lang, text in texts.items():
                    words = Words(lang, text)
                    if sieve:
                        part = has(parts, words.hashes(length - 1))
                        likely = words.whole(length) & part[:-1] & part[1:]
                        at = np.flatnonzero(likely)
                        likely[at] = has(bits, words.hashes(length)[at])
                    else:
                        likely = words.whole(1)
                    for phrase, n in words.counted(np.flatnonzero(likely), length):
                        tally[lang, phrase] += n
                    if buckets:
                        longer = np.flatnonzero(likely[:-1] & likely[1:])
                        buckets.add(words.hashes(length + 1)[longer])
                        if sieve and len(longer):
                            left[lang] = _stretches(words, longer, length + 1)
                if left:
                    yield rows(TEXT, list(left), [x.decode() for x in left.values()], [])
                if len(tally) >= HELD:
                    yield held(tally)
        if tally:
            yield held(tally)
        if buckets:
            found = list(buckets.chunks())
            for i in range(0, len(found), 1_000):
                yield rows(BUCKETS, [], [], [], [c for c, _ in found[i : i + 1_000]], [x for _, x in found[i : i + 1_000]])

    return task


def _stretches(words: Words, places: np.ndarray, length: int) -> bytes:
    """The stretches of words that phrases at these places cover, each as a piece."""
    cut = np.flatnonzero(np.diff(places) > 1) + 1
    begins, ends = places[np.r_[0, cut]], places[np.r_[cut - 1, len(places) - 1]] + length
    return b"\n".join([words.phrase(a, b - a) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])


def _reduced(rows: DataFrame, size: int, least: int) -> np.ndarray:
    """The bitmap of buckets that reach least over all tasks: each chunk is summed where it is dealt to, and sent as bits."""
    schema = StructType([StructField("chunk", IntegerType()), StructField("bits", BinaryType())])
    kind = Buckets(CHUNK, least).n.dtype

    def summed(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for block in blocks:
            for c, data in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                n = np.frombuffer(zlib.decompress(data), kind)
                total[c] = np.minimum(total[c] + n, least).astype(kind) if c in total else n
        bits = {c: np.packbits(n >= least, bitorder="little").tobytes() for c, n in total.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array(list(bits.values()), pa.binary())], schema=to_arrow_schema(schema))

    out = np.zeros(size // 8, np.uint8)
    for c, data in rows.select("chunk", "bytes").repartition("chunk").mapInArrow(summed, schema).collect():
        out[c * CHUNK // 8 : (c + 1) * CHUNK // 8] = np.frombuffer(data, np.uint8)
    return out


def _frequent_bits(frequent: DataFrame, length: int, size: int) -> np.ndarray:
    """The bitmap of the hashes of phrases (lang, phrase) of so many words."""
    schema = StructType([_ROWS["chunk"], _ROWS["bytes"]])

    def marked(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(size, 1)
        for block in blocks:
            for texts in _slices(block):
                for lang, text in texts.items():
                    words = Words(lang, text)
                    buckets.add(words.hashes(length)[words.whole(length)])
        found = list(buckets.chunks())
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], schema=to_arrow_schema(schema))

    return _reduced(frequent.select("lang", "phrase").mapInArrow(marked, schema), size, 1)


def bucket_number(text_bytes: int) -> int:
    size = LEAST_BUCKETS
    while size < MOST_BUCKETS and size * BYTES_A_BUCKET < text_bytes:
        size *= 2
    return size


def frequent_phrases(docs: DataFrame, folder: str, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, f) of phrases of up to `longest` words found least times or more, and (lang, n) with all words of each language.

    buckets: a power of two, CHUNK or more; by default by the bytes of all texts.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = buckets or bucket_number(rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0)
    found, sieve, totals = [], None, None
    for length in range(1, longest + 1):
        path = f"{folder}/pass_{length}"
        rows.mapInArrow(_pass(length, longest, least, size, sieve), _ROWS).write.partitionBy("kind").parquet(path)
        made = spark.read.schema(_ROWS).parquet(path)
        counts = made.filter(F.col("kind") == COUNT)
        if totals is None:
            totals = stored(counts.groupBy("lang").agg(F.sum("n").alias("n")), folder, "totals")
        frequent = counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        frequent = stored(frequent.select("lang", "phrase", F.lit(length).alias("length"), "f"), folder, f"frequent_{length}")
        found.append(frequent)
        if length == longest or frequent.isEmpty():
            break
        shared = spark.sparkContext.broadcast((_reduced(made.filter(F.col("kind") == BUCKETS), size, least), _frequent_bits(frequent, length, size)))
        sieve = lambda shared=shared: shared.value
        if length > 1:
            rows = made.filter(F.col("kind") == TEXT).select("lang", F.col("phrase").alias("text"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return stored(out, folder, "frequent"), totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, buckets: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two words to `longest`.

    Texts in small letters (A-Z) fall into pieces at . , ; : ! ? and line ends,
    and those into words at blanks and tabs. a is how often the phrase is in
    pieces of its language, l and r how often the two parts of its worst cut
    are, n all words; score is floor(1000 a n / (l r)), of the worst cut.
    Phrases that always are within a phrase of one word more don't count.
    A null language is `und`, a null text empty; rows that are there twice
    count twice; other columns are ignored; a table without frequent phrases
    gives no rows. Bytes that aren't UTF-8 are read as U+FFFD.
    """
    folder = scratch_dir(docs.sparkSession)
    frequent, totals = frequent_phrases(docs, folder, text, lang, least, longest, buckets)
    words = F.split("phrase", " ")
    part = lambda begin, n: F.array_join(F.slice(words, begin, n), " ")
    phrases = frequent.filter("length > 1").withColumnRenamed("f", "a")
    # a phrase that is as frequent as one of a word more stands in that one wherever it stands
    longer = frequent.filter("length > 2").withColumn("phrase", F.explode(F.array(part(F.lit(1), F.col("length") - 1), part(F.lit(2), F.col("length") - 1))))
    phrases = phrases.join(longer.select("lang", "phrase", F.col("f").alias("a")).distinct(), ["lang", "phrase", "a"], "left_anti")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = stored(cuts.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.col("length") - F.col("k"))}), folder, "cuts")
    known = lambda name, n: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    df = hot_join(cuts, known("first", "l"), ["lang", "first"], "phrase")
    df = hot_join(df, known("rest", "r"), ["lang", "rest"], "phrase")
    df = hot_join(df, totals, "lang", "phrase")
    whole = lambda name, digits: F.col(name).cast(f"decimal({digits})")
    # whole numbers beyond 64 bits, divided without a rest
    df = df.withColumns({"over": whole("a", 18) * whole("n", 16) * F.lit(1000).cast("decimal(4)"), "under": whole("l", 19) * whole("r", 19)})
    df = df.withColumn("score", F.expr("over DIV under"))
    df = df.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst")).select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return df.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
