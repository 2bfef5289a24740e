"""Feature tables, exports and rule files on disk."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import FIELDS, STRING, table_struct
from tidemark.operators import calendar
from tidemark.operators.model import encode, fit_encoder
from tidemark.operators.ruleset import RuleSet
from tidemark.plans.checking import Scope


class TableError(ValueError):
    """A table is not a feature table of this catalog."""


def save_table(table: DataFrame, path: str) -> None:
    """A feature table as Parquet in order of time, so that a period reads only its row groups."""
    columns = [f.name for f in table_struct()]
    table.select(*columns).repartitionByRange("dt").sortWithinPartitions("dt", "id").write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """A saved feature table. check: refuse one of another catalog or with impossible labels."""
    df = spark.read.parquet(path)
    want = {f.name: f.dataType for f in table_struct()}
    have = {f.name: f.dataType for f in df.schema}
    if have != want:
        raise TableError(f"columns differ from the catalog: {sorted(set(have.items()) ^ set(want.items()), key=str)[:5]}")
    if check:
        bad = df.agg(F.count_if(~F.col("fraud").isin(-1, 0, 1) | F.col("id").isNull() | F.col("dt").isNull()).alias("n")).first().n
        if bad:
            raise TableError(f"{bad} rows without id or time, or with a label other than -1, 0 and 1")
    return df


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A hash of the files' names, sizes and times, to tell whether a cached table is still theirs."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length", "modificationTime")
    rows = sorted(map(tuple, files.collect()), key=str)
    return hashlib.sha256(repr(rows).encode()).hexdigest()


def cached(spark: SparkSession, path: str, sources: tuple[str, ...], build) -> DataFrame:
    """The table at path if it was built from these very files, else build(), stored there."""
    stamp = fingerprint(spark, *sources)
    try:
        if spark.read.text(f"{path}/fingerprint").first()[0] == stamp:
            return spark.read.parquet(f"{path}/table")
    except Exception as e:  # noqa: BLE001  no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.mode("overwrite").parquet(f"{path}/table")
    spark.createDataFrame([(stamp,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/fingerprint")
    return spark.read.parquet(f"{path}/table")


def export(table: DataFrame, path: str, month_days: int = 30) -> dict:
    """Model inputs by split as Parquet and CSV, test rows as JSON, and a manifest; returns the manifest.

    The encoder is fitted on training rows. Readers of one split read only its folder.
    """
    origin = calendar.first_day(table)
    df = table.withColumns({"split": calendar.split(origin, month_days), "month": calendar.month(origin, month_days)})
    texts = [f.name for f in FIELDS if f.kind == STRING]
    encoder = fit_encoder(df.filter("split = 'train'"), texts)
    coded = encode(df, encoder)
    coded.write.mode("overwrite").partitionBy("split").parquet(f"{path}/export")
    coded.filter("split <> 'test'").write.mode("overwrite").partitionBy("split").csv(f"{path}/csv", header=True)
    df.filter("split = 'test'").write.mode("overwrite").json(f"{path}/test")
    counts = {r.split: {"rows": r.n, "fraud": r.f} for r in df.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("fraud") == 1).alias("f")).collect()}
    manifest = {"features": [f.name for f in FIELDS], "categorical": encoder, "origin": origin, "month_days": month_days, "splits": counts}
    spark = table.sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_export(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "valid")) -> DataFrame:
    """Rows of these splits; the folders of others are not read."""
    return spark.read.parquet(f"{path}/export").filter(F.col("split").isin(*splits))


class RuleHistory:
    """Rule sets by version; a version, once given, never changes."""

    def __init__(self):
        self.versions: dict[int, RuleSet] = {}

    def add(self, text: str, scope: Scope | None = None) -> RuleSet:
        """The next version. Nothing is added if the text has errors."""
        version = max(self.versions, default=0) + 1
        self.versions[version] = RuleSet.load(text, scope, version)
        return self.versions[version]

    @property
    def current(self) -> RuleSet:
        return self.versions[max(self.versions)]

    def live_in(self, rule_id: str) -> list[int]:
        """The versions that have this rule as a shadow rule."""
        return [v for v, s in self.versions.items() if any(r.shadow and r.id == rule_id for r in s.rules)]

    def items(self) -> Mapping[int, RuleSet]:
        return dict(self.versions)
