"""Rule texts in columns: what the parser, the checker and the linter say of each, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.checking import lint, load_rules
from tidemark.plans.language import RuleError, parse, show, spell
from tidemark.shipping import ship

#: Texts that a task goes through: some seconds of Python.
TASK = 5_000
DIAGNOSIS = "severity string, line int, place int, width int, marks string, message string"


def spread(df: DataFrame) -> DataFrame:
    """df dealt to tasks by its rows: many texts are few bytes, which a file's reader leaves in one task."""
    return df.repartition(-(-df.count() // TASK) or 1)


def each(df: DataFrame, function: Callable[[str], object], kind: str, column: str = "text") -> Column:
    """function of each text that isn't null, as a column of that kind."""
    ship(df.sparkSession)

    @F.pandas_udf(kind)
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else function(x) for x in texts], dtype=object)

    return made(column)


def diagnosed(df: DataFrame, scope, text: str = "text") -> DataFrame:
    """df with a row for each error of each text, or for each warning if it has no error; texts without any are left out."""

    def found(source: str) -> list[dict]:
        try:
            rules, severity = load_rules(source, scope)[0], "warning"
            problems = lint(rules, scope)
        except RuleError as e:
            severity, problems = "error", e.problems
        return [{"severity": severity, "line": p.line, "place": p.start + 1, "width": p.end - p.start, "marks": p.render().split("\n")[2], "message": p.message} for p in problems]

    return df.select(*df.columns, F.inline(each(df, found, f"array<struct<{DIAGNOSIS}>>", text)))


def words(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a row for each word of each text: its place, kind and value."""
    said = lambda source: [{"place": i, "kind": w.kind, "said": str(w.value)} for i, w in enumerate(w for w in spell(source, 1)[0] if w.kind != "end")]
    return df.select(*df.columns, F.inline(each(df, said, "array<struct<place int, kind string, said string>>", text)))


def canonical(df: DataFrame, text: str = "text") -> Column:
    """The first rule of each text as it is printed, its condition, and its id."""

    def printed(source: str) -> list[str]:
        rule = parse(source)[0][0]
        return [rule.text, show(rule.condition), rule.id]

    return each(df, printed, "array<string>", text)
