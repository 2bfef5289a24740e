"""Numbers as text, in one form everywhere."""

from __future__ import annotations


def figure(x: float | str | None, digits: int = 3) -> str:
    """A value in so many significant digits, or in whole units where it has more of them; whole numbers as they are."""
    if x is None or x != x:
        return "missing"
    if isinstance(x, str):
        return x
    if x == int(x) or abs(x) >= 10**digits:
        return f"{x:,.0f}"
    return f"{x:.{digits}g}"
