"""Rules as Spark columns, and as SQL for other engines.

Three-valued logic is SQL's own, so a condition is one expression and Catalyst
folds, reorders and generates code for it. All rules of a set are evaluated
in one pass over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.plans.checking import ListTable, Scope, values_of
from tidemark.plans.language import Attr, Call, ListName, Lit, Node, Op

_COMPARE = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
_ARITHMETIC = {"+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__}


#: Lists of more values than this are looked up by a join, and those of at most SENT values are sent to all executors for it.
LISTED, SENT = 1_000, 1_000_000


def column(node: Node, scope: Scope | None = None, of=F.col, marks: Mapping[Node, str] | None = None) -> Column:
    """The value of a checked tree; missing and unknown are null. of: how an attribute becomes a column.

    marks: columns that hold the value of some memberships, as with_conditions makes them.
    """
    scope = scope or Scope()
    sub = lambda x: column(x, scope, of, marks)
    match node:
        case Op("in", _) if marks and node in marks:
            return F.col(marks[node])
        case Attr(name):
            return of(name)
        case Lit(v):
            return F.lit(v)
        case Op("not", (x,)):
            return ~sub(x)
        case Op("neg", (x,)):
            return -sub(x)
        case Op("and" | "or", _):
            return _balanced(Column.__and__ if node.op == "and" else Column.__or__, [sub(p) for p in _flat(node)])
        case Op("in", (x, items)):
            return V.membership(sub(x), list(values_of(items, scope)))
        case Op("/", (a, b)):
            return V.divide(sub(a), sub(b))
        case Op(op, (a, b)) if op in _COMPARE:
            return _COMPARE[op](sub(a), sub(b))
        case Op(op, (a, b)):
            return V.number(_ARITHMETIC[op](sub(a), sub(b)))
        case Call("is_missing", (x,)):
            return sub(x).isNull()
        case Call("lower", (x,)):
            while isinstance(x, Call) and x.name == "lower":
                x = x.args[0]
            return V.lower(sub(x))
        case Call("starts_with", (x, y)):
            return F.startswith(sub(x), sub(y))
    raise TypeError(node)


def _memberships(node: Node) -> list[Op]:
    """All lookups in lists within a tree."""
    found, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Op) and x.op == "in":
            found.append(x)
            todo.append(x.args[0])
        elif isinstance(x, (Op, Call)):
            todo.extend(x.args)
    return found


def with_conditions(df: DataFrame, conditions: Mapping[str, Node], scope: Scope | None = None) -> DataFrame:
    """df with a column for each condition: whether it is true; unknown counts as not.

    A long list is joined to the rows, once however often it is asked for the
    same value: sent to all executors if its values, which are counted, are few
    enough, else dealt out by value with the rows, where Spark splits what is
    frequent. A missing value is in no list and not out of it either.
    """
    scope, marks = scope or Scope(), {}
    asked = dict.fromkeys(x for node in conditions.values() for x in _memberships(node))
    for n, x in enumerate(asked):
        held = _list_table(df, x.args[1], scope)
        if held is None:
            continue
        mark, key, there = f"_in_{n}", f"_key_{n}", f"_there_{n}"
        values = held.values.select(F.col("value").alias(f"_value_{n}"), F.lit(True).alias(there))
        values = F.broadcast(values) if held.count() <= SENT else values
        df = df.withColumn(key, column(x.args[0], scope, marks=marks)).join(values, F.col(key) == F.col(f"_value_{n}"), "left")
        df = df.withColumn(mark, F.when(F.col(key).isNotNull(), F.coalesce(there, F.lit(False)))).drop(key, there, f"_value_{n}")
        marks[x] = mark
    made = {name: F.coalesce(column(node, scope, marks=marks), F.lit(False)) for name, node in conditions.items()}
    return df.withColumns(made).drop(*marks.values())


def _list_table(df: DataFrame, items: Node, scope: Scope) -> ListTable | None:
    """The list as a table if it is one or is long, else None."""
    if isinstance(items, ListName) and items.name in scope.tables:
        return scope.tables[items.name]
    held = values_of(items, scope)
    if len(held) <= LISTED:
        return None
    kind = "string" if isinstance(held[0], str) else "double"
    return ListTable(df.sparkSession.createDataFrame([(v,) for v in held], f"value {kind}"), "value")


def _flat(node: Op) -> list[Node]:
    """Operands of nested equal operators, so that a long chain is no deep tree."""
    out: list[Node] = []
    todo = list(node.args)
    while todo:
        x = todo.pop(0)
        if isinstance(x, Op) and x.op == node.op:
            todo = [*x.args, *todo]
        else:
            out.append(x)
    return out


def _balanced(join, parts: list[Column]) -> Column:
    """parts joined as a tree of logarithmic depth: deep ones overflow the planner's stack."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def holds(node: Node, scope: Scope | None = None) -> Column:
    """Whether the condition is true; unknown counts as not."""
    return F.coalesce(column(node, scope), F.lit(False))


def _sql_literal(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        parts = ["'" + p.replace("'", "''") + "'" for p in v.split("\0")]
        return parts[0] if len(parts) == 1 else "(" + " || chr(0) || ".join(parts) + ")"
    if math.isinf(v):
        return f"'{'-' if v < 0 else ''}infinity'::DOUBLE"
    return f"{v!r}::DOUBLE" if v >= 0 else f"({v!r})::DOUBLE"


def sql(node: Node, scope: Scope | None = None) -> str:
    """The same value in DuckDB's SQL."""
    scope = scope or Scope()
    sub = lambda x: sql(x, scope)
    nan = lambda x: f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"
    match node:
        case Attr(name):
            return name
        case Lit(v):
            return _sql_literal(v)
        case Op("not", (x,)):
            return f"(NOT {sub(x)})"
        case Op("neg", (x,)):
            return f"(-{sub(x)})"
        case Op("in", (x, items)):
            held = values_of(items, scope)
            return f"({sub(x)} IN ({', '.join(map(_sql_literal, held))}))" if held else f"(CASE WHEN {sub(x)} IS NOT NULL THEN false END)"
        case Op("/", (a, b)):
            return nan(f"({sub(a)} / nullif({sub(b)}, 0))")
        case Op("!=", (a, b)):
            return f"({sub(a)} <> {sub(b)})"
        case Op("+" | "-" | "*" as op, (a, b)):
            return nan(f"({sub(a)} {op} {sub(b)})")
        case Op(op, (a, b)):
            return f"({sub(a)} {op} {sub(b)})"
        case Call("is_missing", (x,)):
            return f"({sub(x)} IS NULL)"
        case Call("lower", (x,)):
            return f"lower({sub(x)})"
        case Call("starts_with", (x, y)):
            return f"starts_with({sub(x)}, {sub(y)})"
    raise TypeError(node)
