import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesieve.operators import ranges as RG
from framesieve.operators import tables as TB


@pytest.fixture(scope="module")
def skewed(spark):
    """A group of two thirds of the rows over many ranges, small ones, a null one; ties, nulls."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 else None if i % 100 == 0 else f"g{i % 7:02d}"
        rows.append((g, int(rng.integers(0, 50)) if i % 11 else None, i, f"x{i}" if i % 5 else None, [i]))
    return rows, spark.createDataFrame(rows, "`a group` string, t long, id long, label string, many array<long>").repartition(9)


@pytest.mark.parametrize("parts", ["1", "4", "37"])
@pytest.mark.parametrize("down", [True, False])
def test_places_and_rows_before(spark, skewed, parts, down):
    rows, df = skewed
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = [F.col("t").desc_nulls_last() if down else F.col("t").asc_nulls_first(), F.col("id").asc()]
        got = RG.ranked(df, "a group", order, "place", {"before": "label", "id before": "id", "many before": "many"}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, now = {}, None
    for g, t, i, label, many in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", (r[1] is None, -(r[1] or 0)) if down else (r[1] is not None, r[1] or 0), r[2])):
        if now is None or now[0] != g:
            now = (g, 0, None, None, None)
        want[i] = (now[1] + 1, *now[2:])
        now = (g, now[1] + 1, label, i, many)
    assert {r.id: (r.place, r.before, r["id before"], r["many before"]) for r in got} == want and len(got) == len(rows)


def test_no_window_and_empty_tables(spark, skewed):
    _, df = skewed
    assert RG.ranked(df.limit(0), "a group", [F.col("id").asc()], "place").count() == 0
    plan = RG.ranked(df, "a group", [F.col("id").asc()], "place")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


VALUES = {
    "ties": [1.0] * 500 + [2.0] * 499,
    "wide": [10.0**k for k in range(-300, 300, 3)] + [-(10.0**k) for k in range(-300, 300, 7)],
    "near": [1 + k * 2**-52 for k in range(1, 400)],
    "tiny": [k * 5e-324 for k in range(-60, 61)],
    "odd": [math.nan, math.inf, -math.inf, 0.0, -0.0, 1.0, -1.0, math.nan, 1.7e308, -1.7e308],
    "one": [7.5],
    None: [3.0, 1.0, 2.0, 2.5],
}


def test_selection(spark, duck):
    rng = np.random.default_rng(0)
    values = VALUES | {"hot": list(rng.normal(0, 1e-3, 4000)), "log": list(np.exp(rng.normal(0, 30, 3000)))}
    rows = [(g, float(x)) for g, own in values.items() for x in own] + [("none", None), ("hot", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(None if g is None or g == "None" else str(g), None if x is None or x == "None" else float(x)) for g, x in rows], "`the group` string, v double").repartition(7)
    got = {r[0]: tuple(r)[1:] for r in RG.selected(df, ["the group"], "v", {"low": F.lit(0), "tenth": F.expr("n div 10"), "top": F.col("n") - 1}).collect()}
    assert got.keys() == values.keys()
    for g, own in values.items():
        ordered = sorted(own, key=lambda x: (math.isnan(x), 0 if math.isnan(x) else x))
        want = (len(own), ordered[0], ordered[len(own) // 10], ordered[-1])
        assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got[g], want, strict=True)), g
    finite = df.where("`the group` <> 'odd' OR `the group` IS NULL")
    medians = {r[0]: r.median for r in RG.exact_median(finite, ["the group"], "v").collect()}
    assert medians == {g: float(np.median(own)) for g, own in values.items() if g != "odd"}
    discs = {r[0]: r.v for r in RG.nth_element(finite, "the group", "v", 0.3).collect()}
    assert discs == {r[0]: r[1] for r in finite.where("v IS NOT NULL").groupBy("the group").agg(F.expr("percentile_disc(0.3) WITHIN GROUP (ORDER BY v)")).collect()}
    assert RG.selected(df.limit(0), ["the group"], "v", {"low": F.lit(0)}).count() == 0


def test_only_counts_are_shuffled(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), F.rand(1).alias("v"))
    got = {r.g: r.median for r in RG.exact_median(df, ["g"], "v").collect()}
    assert got == {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}


def test_names_meet_without_a_product(spark):
    left, right = spark.createDataFrame([(1, "Asia"), (2, None), (3, "none")], "k long, wanted string"), spark.createDataFrame([("ASIA",), ("Europe",), (None,)], "name string")
    found = TB.join_by_name(left, "wanted", right, "name")
    assert [tuple(r) for r in found.collect()] == [(1, "Asia", "ASIA")] and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
