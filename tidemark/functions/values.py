"""Scalar functions whose missing values follow one rule: null, and nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType


def number(x: Column) -> Column:
    """x as a double; NaN becomes null, so that no comparison ever sees one."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def text(x: Column) -> Column:
    """x, with the empty string as null."""
    return F.nullif(x, F.lit(""))


def normalised(df: DataFrame) -> DataFrame:
    """df with missing numbers and strings as null."""
    changed = {}
    for f in df.schema:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            changed[f.name] = number(F.col(f.name))
        elif isinstance(f.dataType, StringType):
            changed[f.name] = text(F.col(f.name))
    return df.withColumns(changed)


def milli(amount: Column) -> Column:
    """An amount in thousandths, half away from zero; a missing one counts 0."""
    return F.coalesce(F.round(amount * 1000).cast("bigint"), F.lit(0).cast("bigint"))


def lower(x: Column) -> Column:
    """Letter by letter: a dotted capital I and a final sigma are no special cases."""
    return F.lower(F.translate(x, "İΣ", "iσ"))


def divide(a: Column, b: Column) -> Column:
    return number(F.try_divide(a, b))


def membership(x: Column, values: list) -> Column:
    """x in values; unknown for a missing x even if there are no values."""
    return x.isin(*values) if values else F.when(x.isNotNull(), F.lit(False))
