"""Rules row by row in plain Python: the yardstick for the compiled forms, and the folder of constants.

A missing value and an unknown condition are both None.
"""

from __future__ import annotations

from collections.abc import Mapping

from tidemark.plans.checking import Scope, values_of
from tidemark.plans.language import Attr, Call, Lit, Node, Op, walk


def _number(x: float | None) -> float | None:
    return None if x is None or x != x else x


def lower(s: str) -> str:
    """Letter by letter, one for one."""
    return "".join("i" if c == "İ" else c.lower() if len(c.lower()) == 1 else c for c in s)


def value(node: Node, row: Mapping, scope: Scope):
    match node:
        case Attr(name):
            v = row.get(name)
            return None if v is None or v == "" or v != v else v
        case Lit(v):
            return v
        case Op("not", (x,)):
            v = value(x, row, scope)
            return None if v is None else not v
        case Op("neg", (x,)):
            v = value(x, row, scope)
            return None if v is None else -v
        case Op("and" | "or" as op, (a, b)):
            both = (value(a, row, scope), value(b, row, scope))
            decides = op == "or"
            return decides if decides in both else None if None in both else not decides
        case Op("in", (x, items)):
            v = value(x, row, scope)
            return None if v is None else v in values_of(items, scope)
        case Op(op, (a, b)):
            x, y = value(a, row, scope), value(b, row, scope)
            if x is None or y is None:
                return None
            match op:
                case "=":
                    return x == y
                case "!=":
                    return x != y
                case "<":
                    return x < y
                case "<=":
                    return x <= y
                case ">":
                    return x > y
                case ">=":
                    return x >= y
                case "+":
                    return _number(x + y)
                case "-":
                    return _number(x - y)
                case "*":
                    return _number(x * y)
                case "/":
                    return None if y == 0 else _number(x / y)
        case Call("is_missing", (x,)):
            return value(x, row, scope) is None
        case Call("lower", (x,)):
            v = value(x, row, scope)
            return None if v is None else lower(v)
        case Call("starts_with", (x, y)):
            a, b = value(x, row, scope), value(y, row, scope)
            return None if a is None or b is None else a.startswith(b)
    raise TypeError(node)


def matches(node: Node, row: Mapping, scope: Scope) -> bool:
    return value(node, row, scope) is True


def constant_value(node: Node, scope: Scope) -> tuple[bool, bool]:
    """(whether the condition is the same for every row, whether it then holds)."""
    match node:
        case Op("and" | "or" as op, (a, b)):
            decides = op == "or"
            parts = [constant_value(x, scope) for x in (a, b)]
            if any(known and holds == decides and (decides or value_known(x, scope)) for (known, holds), x in zip(parts, (a, b), strict=True)):
                return True, decides
    if any(isinstance(n, Attr) for n in walk(node)):
        return False, False
    return True, matches(node, {}, scope)


def value_known(node: Node, scope: Scope) -> bool:
    """Whether a constant condition is false rather than unknown, so that it decides an and."""
    return not any(isinstance(n, Attr) for n in walk(node)) and value(node, {}, scope) is not None
