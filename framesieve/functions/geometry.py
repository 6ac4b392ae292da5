"""Similarity transforms as structs of a, b, tx, ty: x' = a x - b y + tx, y' = b x + a y + ty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def transform(a: Column, b: Column, tx: Column, ty: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), tx.alias("tx"), ty.alias("ty"))


def forward(t: Column, x: Column, y: Column) -> Column:
    """struct(x, y)."""
    return F.struct((t["a"] * x - t["b"] * y + t["tx"]).alias("x"), (t["b"] * x + t["a"] * y + t["ty"]).alias("y"))


def inverse(t: Column) -> Column:
    """The transform back; null if it has no inverse."""
    d = F.nullif(t["a"] * t["a"] + t["b"] * t["b"], F.lit(0.0))
    a, b = t["a"] / d, -t["b"] / d
    return transform(a, b, -(a * t["tx"] - b * t["ty"]), -(b * t["tx"] + a * t["ty"]))


def compose(s: Column, t: Column) -> Column:
    """First t, then s."""
    moved = forward(s, t["tx"], t["ty"])
    return transform(s["a"] * t["a"] - s["b"] * t["b"], s["b"] * t["a"] + s["a"] * t["b"], moved["x"], moved["y"])


def angle(t: Column) -> Column:
    return F.atan2(t["b"], t["a"])


def scale(t: Column) -> Column:
    return F.sqrt(t["a"] * t["a"] + t["b"] * t["b"])


def solve_two(rx0: Column, ry0: Column, fx0: Column, fy0: Column, rx1: Column, ry1: Column, fx1: Column, fy1: Column) -> Column:
    """The transform that takes two points to two points; null for points closer than 10 or a scale more than 5 % off (squared)."""
    dx, dy, ex, ey = fx0 - fx1, fy0 - fy1, rx0 - rx1, ry0 - ry1
    d = dx * dx + dy * dy
    wide = F.when(d >= 100, d)
    a, b = (dx * ex + dy * ey) / wide, (dx * ey - dy * ex) / wide
    t = transform(a, b, rx0 - a * fx0 + b * fy0, ry0 - b * fx0 - a * fy0)
    return F.when(F.abs(a * a + b * b - 1) <= 0.05, t)
