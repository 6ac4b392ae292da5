"""Script values as columns: strings that count as numbers where both sides do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def as_number(text: Column) -> Column:
    """The value as a double; null if it is none."""
    return F.trim(text).try_cast("double")


def shown(number: Column) -> Column:
    """Whole numbers below 1e15 without a fraction."""
    return F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("decimal(20,0)").cast("string")).otherwise(number.cast("string"))


def plus(a: Column, b: Column) -> Column:
    """Sum of two numbers, else both strings joined."""
    x, y = as_number(a), as_number(b)
    return F.when(x.isNotNull() & y.isNotNull(), shown(x + y)).otherwise(F.concat(a, b))


def arithmetic(a: Column, b: Column, sign: str) -> Column:
    """a - b, a * b, a / b or a ^ b as a number; null where a side is no number or the divisor is 0."""
    x, y = as_number(a), as_number(b)
    return {"-": x - y, "*": x * y, "/": F.try_divide(x, y), "^": F.pow(x, y)}[sign]


def number_function(name: str, *arguments: Column) -> Column:
    """round (away from zero at a half), ceil, floor, abs, sqrt, min or max of numbers in text; null where one is no number, and for the root of one below 0."""
    x = [as_number(a) for a in arguments]
    known = x[0].isNotNull()
    for other in x[1:]:
        known = known & other.isNotNull()
    value = {
        "round": lambda v: F.signum(v) * F.floor(F.abs(v) + 0.5),
        "ceil": lambda v: F.ceil(v).cast("double"),
        "floor": lambda v: F.floor(v).cast("double"),
        "abs": F.abs,
        "sqrt": lambda v: F.when(v >= 0, F.sqrt(v)),
        "min": F.least,
        "max": F.greatest,
    }[name](*x)
    return F.when(known, value)


def compare(a: Column, b: Column, sign: str) -> Column:
    """Numbers by size (equal within epsilon), other strings in capitals."""
    x, y = as_number(a), as_number(b)
    both, same = x.isNotNull() & y.isNotNull(), F.abs(x - y) < EPSILON
    s, t = F.upper(a), F.upper(b)
    numeric = {"==": same, "!=": ~same, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[sign]
    text = {"==": s == t, "!=": s != t, "<": s < t, ">": s > t, "<=": s <= t, ">=": s >= t}[sign]
    return F.when(both, numeric).otherwise(text)


def truth(text: Column) -> Column:
    """Neither empty nor ``false`` nor ``0``."""
    return ~F.lower(text).isin("", "false", "0")


def plain_quotes(text: Column) -> Column:
    """Typographic quotes as plain ones."""
    return F.translate(text, "“”‘’", "\"\"''")
