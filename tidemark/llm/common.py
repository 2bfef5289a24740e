"""What the text operators share: texts in batches, scratch tables, salted joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.scratch import scratch_dir, stored  # noqa: F401
from tidemark.shipping import ship

#: Rows are handed to Python code in slices of about this many characters, so
#: that a batch of very long texts never has to be decoded at once.
SLICE_CHARS = 1_500_000

#: What separates words in the contracts on white space (as Java and RE2 class).
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z; no other letter changes."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """make(), kept in this process for its later tasks until something else is kept: one large tool at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def map_text(
    df: DataFrame,
    function: Callable[..., dict[str, list]],
    columns: Sequence[str],
    schema: StructType,
    *,
    text: str | None = "text",
    make: Callable[[], object] | None = None,
    carry: bool = False,
) -> DataFrame:
    """Apply function to slices of df's rows in Arrow batches.

    function gets one Python list per name in columns, and what make() returned
    in its process if make is given; it returns lists by the names of schema.
    The slices are cut by the length of the text column, not by row count alone.
    Bytes of a string that aren't UTF-8 are read as U+FFFD; carried columns keep them.
    carry: all columns of df that schema doesn't name stay beside the new ones;
    function must then return a value for each row.
    """
    ship(df.sparkSession)
    carried = [f for f in df.schema if carry and f.name not in schema.names]
    schema = StructType([*carried, *schema])
    out = to_arrow_schema(schema)
    made_fields = [out.field(i) for i in range(len(carried), len(out))]
    first = len(columns)
    where = list(columns).index(text) if text in columns else None

    def batches(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = [make()] if make else []
        for block in blocks:
            begin, n = 0, block.num_rows
            while begin < n:
                end = n if where is None else _slice_end(block.column(where), begin, n)
                lists = [values(block.column(i).slice(begin, end - begin)) for i in range(len(columns))]
                made = function(*tool, *lists)
                beside = [block.column(first + i).slice(begin, end - begin).cast(out.field(i).type) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*beside, *(pa.array(made[f.name], f.type) for f in made_fields)], schema=out)
                begin = end

    return df.select(*columns, *(df[f.name].alias(f"_kept{i}") for i, f in enumerate(carried))).mapInArrow(batches, schema)


def values(column: pa.Array) -> list:
    """The column's values; of strings that aren't valid UTF-8, U+FFFD for each part that isn't."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _slice_end(column: pa.Array, begin: int, n: int) -> int:
    total = 0
    for i in range(begin, n):
        value = column[i]
        total += 200 + (len(value.as_buffer()) if value.is_valid else 0)
        if total >= SLICE_CHARS:
            return i + 1
    return n


def hashed_sample(df: DataFrame, key: str, rows: int, n: int | None = None) -> DataFrame:
    """At most `rows` rows of df, those with the least hashes of key; equal keys stay or go by the order of all columns.

    A large table is first thinned to hashes that some four times as many rows
    have, so what its tasks send grows with `rows` and not with their number.
    n: about how many rows df has; counted if not given.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    n = df.count() if n is None else n
    if n > 8 * rows:
        df = df.filter(place < F.lit(int(4 * rows / n * (1 << 40))))
    return df.withColumn("_place", place).orderBy("_place", *df.columns).limit(rows).drop("_place")


def unused(names: Sequence[str], *wanted: str) -> list[str]:
    """wanted, each with underscores before it until none of names is alike, in capitals or not."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: A key's rows are dealt to groups of about HOT_ROWS, or of one in HOT_PARTS of all rows where that is more.
HOT_ROWS, HOT_PARTS = 64, 1_000


def hot_keys(counts: DataFrame, keys: Sequence[str], n: int) -> tuple[DataFrame, str]:
    """The keys of counts (keys, n) that need several groups, with how many; and that column's name.

    n is the sum of all counts, or more. At most HOT_PARTS keys have more than
    one in HOT_PARTS of n rows, so this table may be broadcast at any size.
    """
    group = max(HOT_ROWS, -(-n // HOT_PARTS))
    (groups,) = unused([*counts.columns, *keys], "_groups")
    return counts.filter(F.col("n") > group).select(*keys, F.ceil(F.col("n") / group).cast("int").alias(groups)), groups


def hot_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], by: str | Sequence[str], how: str = "inner", counts: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """Equi-join of a left side that may be skewed with a right side that is unique on keys, or nearly so.

    A key's left rows are dealt by a hash of their columns `by` to as many
    groups as their number asks for, and its right rows go to each of them; so
    no key's rows meet in one task, and what is repeated stays a small part.
    counts has (keys, n) for left, and is made from it if not given; n is their
    sum or more. how: inner, left or left_semi. Left rows with a null key match
    nothing and are dealt out too.
    """
    keys, by = ([x] if isinstance(x, str) else list(x) for x in (keys, by))
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count("*").alias("n"))
    n = (counts.agg(F.sum("n")).first()[0] or 0) if n is None else n
    hot, groups = hot_keys(counts, keys, n)
    named, salt = unused([*left.columns, *right.columns], "_groups", "_salt")
    hot = hot.withColumnRenamed(groups, named)
    many = F.coalesce(F.col(named), F.lit(1))
    keyless = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    left = left.join(F.broadcast(hot), keys, "left").withColumn(salt, F.pmod(F.xxhash64(*by), F.when(keyless, HOT_PARTS).otherwise(many)).cast("int")).drop(named)
    right = right.join(F.broadcast(hot), keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), many - 1))).drop(named)
    return left.join(right, [*keys, salt], how).drop(salt)
