"""Native scalar functions as column expressions, so that they stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from relsat.catalog import Native

_SIGN, _WORD = 1 << 31, (1 << 32) - 1


def wrap32(c: Column) -> Column:
    """Two's complement wrap-around of a 64-bit result to 32 bits."""
    return ((c + F.lit(_SIGN)).bitwiseAND(F.lit(_WORD)) - F.lit(_SIGN)).cast("int")


def _wide(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: wrap32(f(a.cast("bigint"), b.cast("bigint")))


def _divide(a: Column, b: Column) -> Column:
    """Truncating quotient; a zero divisor raises in ANSI mode. The one overflow wraps."""
    return wrap32(F.call_function("div", a.cast("bigint"), b.cast("bigint")))


def prelude() -> dict[str, Native]:
    two = ("i32", "i32")
    out = {
        "add": Native(two, "i32", _wide(lambda a, b: a + b)),
        "sub": Native(two, "i32", _wide(lambda a, b: a - b)),
        "mul": Native(two, "i32", _wide(lambda a, b: a * b)),
        "div": Native(two, "i32", _divide),
        "eq": Native(two, "bool", lambda a, b: a == b),
        "neq": Native(two, "bool", lambda a, b: a != b),
        "lt": Native(two, "bool", lambda a, b: a < b),
        "gt": Native(two, "bool", lambda a, b: a > b),
        "leq": Native(two, "bool", lambda a, b: a <= b),
        "geq": Native(two, "bool", lambda a, b: a >= b),
        "not": Native(("bool",), "bool", lambda a: ~a),
        "and": Native(("bool", "bool"), "bool", lambda a, b: a & b),
        "or": Native(("bool", "bool"), "bool", lambda a, b: a | b),
    }
    return out
