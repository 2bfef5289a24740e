"""Months counted from the data's first day, and the split into train, valid and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def first_day(df: DataFrame) -> int:
    low = df.agg(F.min("dt")).first()[0]
    return 0 if low is None else low // DAY * DAY


def month(origin: int, days: int = 30) -> Column:
    """Months of `days` days since origin, 0 to 5; what lies beyond counts to the nearest."""
    return F.least(F.greatest(F.floor((F.col("dt") - origin) / (days * DAY)), F.lit(0)), F.lit(5)).cast("int")


def split(origin: int, days: int = 30) -> Column:
    m = month(origin, days)
    return F.when(m <= 3, "train").when(m == 4, "valid").otherwise("test")


def split_counts(df: DataFrame, days: int = 30) -> DataFrame:
    """(split, rows, fraud): how many rows and frauds each split has."""
    return df.groupBy(split(first_day(df), days).alias("split")).agg(F.count("*").alias("rows"), F.count_if(F.col("fraud") == 1).alias("fraud"))
