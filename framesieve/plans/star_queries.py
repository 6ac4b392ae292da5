"""Queries on stars: maxima, shapes, triangles, neighbours, transforms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.functions import geometry as GE
from framesieve.operators import frames as FR
from framesieve.operators import heat as H
from framesieve.operators import matching as M
from framesieve.operators import registration as R
from framesieve.operators import stars as S
from framesieve.operators.tables import materialised
from framesieve.plans import sql
from framesieve.plans.session_queries import rounded
from framesieve.sources.adapters import SIDE, images, pixels

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


_MAXIMA = f"""WITH {sql.PIXELS}, o AS (SELECT p.vec_id, p.label, p.i, p.x, p.y, p.v, max(q.v) AS other FROM pixels p JOIN pixels q ON q.vec_id = p.vec_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND q.i <> p.i GROUP BY ALL),
maxima AS (SELECT vec_id, label, i, x, y, v FROM o WHERE v > other)"""


@query(f"{_MAXIMA} SELECT vec_id, x, y, round(v, 6) AS v FROM maxima")
def q_local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(FR.frame_maxima(images(spark, sf_dir), ["vec_id"], SIDE, SIDE))


_SHAPES = f"""WITH {sql.PIXELS}, w AS (SELECT vec_id, label, x, y, v - 0.5 AS w FROM pixels WHERE v > 0.5), c AS (SELECT vec_id, sum(w) AS m, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy FROM w GROUP BY 1), k AS (
  SELECT w.vec_id, label, cx, cy, sum(w * (x - cx) * (x - cx)) / m AS xx, sum(w * (y - cy) * (y - cy)) / m AS yy, sum(w * (x - cx) * (y - cy)) / m AS xy, max(x) - min(x) AS dx, max(y) - min(y) AS dy
  FROM w JOIN c ON c.vec_id = w.vec_id GROUP BY w.vec_id, label, cx, cy, m), e AS (
  SELECT *, (xx + yy) / 2 AS h, sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS t FROM k), shapes AS (
  SELECT vec_id, label, cx, cy, CASE WHEN dx >= 1 AND dy >= 1 THEN 2.355 * sqrt(h) END AS fwhm, CASE WHEN h + t > 0 AND h - t >= 0 THEN sqrt(1 - (h - t) / (h + t)) END AS eccentricity FROM e)"""


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bright = pixels(spark, sf_dir).select("vec_id", "label", "x", "y", (F.col("v") - 0.5).alias("w"))
    return S.moment_shapes(bright, ["vec_id", "label"])


@query(f"{_SHAPES} SELECT vec_id, label, round(cx, 6) AS cx, round(cy, 6) AS cy, round(fwhm, 6) AS fwhm, round(eccentricity, 6) AS eccentricity FROM shapes")
def q_moment_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_shapes(spark, sf_dir))


@query(f"{_SHAPES} SELECT label, count(*) AS detected_stars, count(*) FILTER (fwhm > 0.5 AND fwhm < 50) AS star_count, round(median(fwhm) FILTER (fwhm > 0.5 AND fwhm < 50), 6) AS fwhm, round(median(eccentricity), 6) AS eccentricity FROM shapes GROUP BY 1")
def q_frame_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.frame_shapes(_shapes(spark, sf_dir), "label"))


@query(
    f"""{_SHAPES}, p AS (SELECT label, least(floor(cx / (7.0 / 5)), 4)::INT AS gx, least(floor(cy / (7.0 / 5)), 4)::INT AS gy, fwhm FROM shapes), m AS (SELECT label, gx, gy, avg(fwhm) AS c FROM p GROUP BY ALL), a AS (SELECT label, avg(fwhm) AS w FROM shapes GROUP BY 1)
SELECT a.label, g.gx, h.gy, round(coalesce(c, w), 6) AS fwhm FROM a CROSS JOIN (SELECT unnest(range(5))::INT AS gx) g CROSS JOIN (SELECT unnest(range(5))::INT AS gy) h LEFT JOIN m ON m.label = a.label AND m.gx = g.gx AND m.gy = h.gy"""
)
def q_heat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean FWHM on a grid of 5 by 5 cells over the images of a label."""
    return rounded(S.heat_grid(_shapes(spark, sf_dir), "label", 7.0, 7.0, 5))


_HEAT = f"""{_SHAPES}, hc AS (SELECT label, count(*) AS n, avg(fwhm) AS w, CASE WHEN count(*) >= 3600 THEN 15 WHEN count(*) >= 2500 THEN 13 WHEN count(*) >= 1600 THEN 11 WHEN count(*) >= 900 THEN 9 WHEN count(*) >= 400 THEN 7 ELSE 5 END AS g
  FROM shapes GROUP BY 1 HAVING count(*) >= 25), hp AS (SELECT s.label, least(floor(cx / (7.0::DOUBLE / g)), g - 1)::INT AS gx, least(floor(cy / (7.0::DOUBLE / g)), g - 1)::INT AS gy, fwhm FROM shapes s JOIN hc ON hc.label = s.label), hm AS (
  SELECT label, gx, gy, avg(fwhm) AS f FROM hp GROUP BY ALL), he AS (
  SELECT hc.label, g, n, x.gx, y.gy, coalesce(f, w) AS fwhm FROM hc JOIN (SELECT unnest(range(15))::INT AS gx) x ON x.gx < g JOIN (SELECT unnest(range(15))::INT AS gy) y ON y.gy < g
  LEFT JOIN hm ON hm.label = hc.label AND hm.gx = x.gx AND hm.gy = y.gy), hr AS (SELECT label, min(fwhm) AS low, greatest(max(fwhm) - min(fwhm), 0.01) AS span FROM he GROUP BY 1)"""


@query(f"{_HEAT} SELECT he.label, g AS grid, gx, gy, round(fwhm, 6) AS fwhm, n < 75 AS few, least(floor((fwhm - low) / (span / 11)), 10)::INT AS level FROM he JOIN hr ON hr.label = he.label")
def q_heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat grids whose side follows the number of stars, with each cell's contour level; labels of few stars are marked or left out."""
    return rounded(S.heat_map(_shapes(spark, sf_dir), "label", 7.0, 7.0))


#: Size of the pictures drawn of heat maps.
_WIDE, _HIGH = 24, 18
_FIELD = f"""{_HEAT}, aa AS (SELECT DISTINCT label, g, x.x, y.y, (x.x + 0.5::DOUBLE) / ({_WIDE}.0::DOUBLE / g) - 0.5 AS ax, (y.y + 0.5::DOUBLE) / ({_HIGH}.0::DOUBLE / g) - 0.5 AS ay FROM he
  CROSS JOIN (SELECT unnest(range({_WIDE}))::INT AS x) x CROSS JOIN (SELECT unnest(range({_HIGH}))::INT AS y) y), ce AS (
  SELECT *, greatest(0, least(g - 1, floor(ax)))::INT AS x0, greatest(0, least(g - 1, floor(ay)))::INT AS y0 FROM aa), co AS (
  SELECT ce.label, x, y, greatest(0, least(1, ax - x0)) AS tx, greatest(0, least(1, ay - y0)) AS ty, a.fwhm AS f00, b.fwhm AS f10, c.fwhm AS f01, d.fwhm AS f11 FROM ce
  JOIN he a ON a.label = ce.label AND a.gx = x0 AND a.gy = y0 JOIN he b ON b.label = ce.label AND b.gx = least(x0 + 1, ce.g - 1) AND b.gy = y0
  JOIN he c ON c.label = ce.label AND c.gx = x0 AND c.gy = least(y0 + 1, ce.g - 1) JOIN he d ON d.label = ce.label AND d.gx = least(x0 + 1, ce.g - 1) AND d.gy = least(y0 + 1, ce.g - 1)), field AS (
  SELECT label, x, y, (f00 + (f10 - f00) * tx) + ((f01 + (f11 - f01) * tx) - (f00 + (f10 - f00) * tx)) * ty AS v FROM co)"""


@query(
    f"""{_FIELD}, li AS (SELECT label, i::INT AS level, low + span * i / 7 AS value FROM hr CROSS JOIN (SELECT unnest(range(1, 7)) AS i))
SELECT DISTINCT f.label, level, round(value, 6) AS value, f.x, f.y FROM field f JOIN li ON li.label = f.label JOIN field n ON n.label = f.label AND abs(n.x - f.x) + abs(n.y - f.y) = 1
WHERE f.x BETWEEN 1 AND {_WIDE - 2} AND f.y BETWEEN 1 AND {_HIGH - 2} AND (f.v - value) * (n.v - value) < 0"""
)
def q_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels on six contour lines of each label's heat map."""
    cells = S.heat_map(_shapes(spark, sf_dir), "label", 7.0, 7.0).select("label", "grid", "gx", "gy", "fwhm")
    return rounded(H.contours(cells, "label", _WIDE, _HIGH, 6))


@query(
    f"""{_FIELD}, sh AS (SELECT f.label, x, y, greatest(0, least(1, (v - low) / span)) * 4 AS s FROM field f JOIN hr ON hr.label = f.label), st AS (
  SELECT *, least(floor(s), 3)::INT + 1 AS k, [[59, 76, 192], [124, 159, 234], [221, 221, 221], [229, 134, 107], [180, 4, 38]] AS p FROM sh)
SELECT label, (y * {_WIDE} + x)::INT AS i, c.c AS channel, floor(p[k][c + 1] + (p[k + 1][c + 1] - p[k][c + 1]) * (s - (k - 1)) + 0.5)::INT AS v FROM st CROSS JOIN (SELECT unnest([0, 1, 2])::INT AS c) c"""
)
def q_heat_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's heat map as a picture in the colours of a palette."""
    cells = S.heat_map(_shapes(spark, sf_dir), "label", 7.0, 7.0).select("label", "grid", "gx", "gy", "fwhm")
    drawn = H.heat_pictures(cells, "label", _WIDE, _HIGH, "coolwarm").select("label", F.posexplode("pixels").alias("k", "v"))
    return drawn.select("label", F.expr("k div 3").cast("int").alias("i"), (F.col("k") % 3).alias("channel"), "v")


@query(f"{_SHAPES} SELECT vec_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(fwhm / 2, 6) AS r FROM shapes WHERE fwhm BETWEEN 0.5 AND 50")
def q_star_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A circle for every star of plausible width."""
    return rounded(FR.star_overlay(_shapes(spark, sf_dir), ["vec_id"]))


@query(f"{_MAXIMA} SELECT vec_id, i AS star_id, round(v, 6) AS peak FROM maxima QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) <= 4")
def q_brightest_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.brightest(_peaks(spark, sf_dir).withColumnRenamed("v", "peak"), "vec_id", 4).select("vec_id", "star_id", "peak"))


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = FR.frame_maxima(images(spark, sf_dir), ["vec_id"], SIDE, SIDE)
    return found.select("vec_id", (F.col("y") * 8 + F.col("x")).alias("star_id"), "x", "y", "v")


#: Triangles are made of a frame's brightest stars only.
_BRIGHT = 9
_TRIANGLES = f"""{_MAXIMA}, bright AS (SELECT * FROM maxima QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) <= {_BRIGHT}), sides AS (SELECT a.vec_id, a.i, b.i AS j, c.i AS k, list_sort([sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), sqrt(pow(b.x - c.x, 2) + pow(b.y - c.y, 2)), sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2))]) AS d,
  (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS z FROM bright a JOIN bright b ON b.vec_id = a.vec_id AND b.i > a.i JOIN bright c ON c.vec_id = a.vec_id AND c.i > b.i), triangles AS (
  SELECT vec_id, i, j, k, d[2] / d[3] AS r1, d[1] / d[3] AS r2, CASE WHEN z >= 0 THEN 1 ELSE -1 END AS orientation FROM sides WHERE d[1] >= 1)"""


def _bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.brightest(_peaks(spark, sf_dir).withColumnRenamed("v", "peak"), "vec_id", _BRIGHT)


@query(f"{_TRIANGLES} SELECT vec_id, i, j, k, round(r1, 6) AS r1, round(r2, 6) AS r2, orientation FROM triangles")
def q_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.triangles(_bright(spark, sf_dir), ["vec_id"]))


@query(
    f"""{_TRIANGLES} SELECT l.vec_id // 2 AS pair, count(*) AS matches, round(avg(sqrt(pow(l.r1 - r.r1, 2) + pow(l.r2 - r.r2, 2))), 6) AS gap FROM triangles l JOIN triangles r
ON r.vec_id = l.vec_id + 1 AND l.vec_id % 2 = 0 AND l.orientation = r.orientation WHERE sqrt(pow(l.r1 - r.r1, 2) + pow(l.r2 - r.r2, 2)) <= 0.02 GROUP BY 1"""
)
def q_triangle_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alike triangles between every two neighbouring images."""
    t = M.triangles(_bright(spark, sf_dir), ["vec_id"]).withColumn("pair", F.floor(F.col("vec_id") / 2))
    left, right = t.where("vec_id % 2 = 0").drop("vec_id"), t.where("vec_id % 2 = 1").drop("vec_id")
    return rounded(M.match_triangles(left, right, ["pair"]).groupBy("pair").agg(F.count("*").alias("matches"), F.avg("gap").alias("gap")))


_NEAREST = f"""{_MAXIMA}, n AS (SELECT a.vec_id // 2 AS pair, a.i AS star_id, b.i AS ref_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance, a.x AS fx, a.y AS fy, b.x AS rx, b.y AS ry
  FROM maxima a JOIN maxima b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0), nearest AS (SELECT * FROM n WHERE distance < 3 QUALIFY row_number() OVER (PARTITION BY pair, star_id ORDER BY distance, ref_id) = 1)"""


def _nearest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = _peaks(spark, sf_dir).withColumn("pair", F.floor(F.col("vec_id") / 2))
    left, right = p.where("vec_id % 2 = 0"), p.where("vec_id % 2 = 1")
    return M.nearest(left, right, ["pair"], 3.0), left, right


@query(f"{_NEAREST} SELECT pair, star_id, ref_id, round(distance, 6) AS distance FROM nearest")
def q_nearest_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_nearest(spark, sf_dir)[0])


@query(
    f"""{_NEAREST}, m AS (SELECT pair, count(*) AS n, avg(fx) AS mfx, avg(fy) AS mfy, avg(rx) AS mrx, avg(ry) AS mry FROM nearest GROUP BY 1), s AS (
  SELECT m.pair, m.n, mfx, mfy, mrx, mry, sum(pow(fx - mfx, 2) + pow(fy - mfy, 2)) AS ff, sum((fx - mfx) * (rx - mrx) + (fy - mfy) * (ry - mry)) AS sa, sum((fx - mfx) * (ry - mry) - (fy - mfy) * (rx - mrx)) AS sb
  FROM nearest q JOIN m ON m.pair = q.pair GROUP BY ALL), t AS (SELECT *, CASE WHEN n >= 2 AND ff >= 1e-10 THEN sa / ff END AS a, CASE WHEN n >= 2 AND ff >= 1e-10 THEN sb / ff END AS b FROM s)
SELECT pair, n, round(a, 6) + 0 AS a, round(b, 6) + 0 AS b, round(mrx - a * mfx + b * mfy, 6) + 0 AS tx, round(mry - b * mfx - a * mfy, 6) + 0 AS ty FROM t"""
)
def q_similarity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform between neighbouring images from their matched stars."""
    near, left, right = _nearest(spark, sf_dir)
    pairs = near.join(left.select("pair", "star_id", F.col("x").alias("fx"), F.col("y").alias("fy")), ["pair", "star_id"])
    pairs = pairs.join(right.select("pair", F.col("star_id").alias("ref_id"), F.col("x").alias("rx"), F.col("y").alias("ry")), ["pair", "ref_id"])
    return rounded(M.similarity_of_pairs(pairs, ["pair"]))


_SOLVED = """WITH p AS (SELECT event_id, value + 40 AS rx0, value / 2 AS ry0, value AS fx0, value / 3 AS fy0, 3 * value AS rx1, value / 4 + 20 AS ry1, 3 * value - 41 + event_id % 5 AS fx1, value / 5 AS fy1 FROM events), d AS (
  SELECT *, pow(fx0 - fx1, 2) + pow(fy0 - fy1, 2) AS q FROM p), s AS (SELECT *, CASE WHEN q >= 100 THEN ((fx0 - fx1) * (rx0 - rx1) + (fy0 - fy1) * (ry0 - ry1)) / q END AS a, CASE WHEN q >= 100 THEN ((fx0 - fx1) * (ry0 - ry1) - (fy0 - fy1) * (rx0 - rx1)) / q END AS b FROM d), t AS (
  SELECT event_id, a, b, rx0 - a * fx0 + b * fy0 AS tx, ry0 - b * fx0 - a * fy0 AS ty FROM s WHERE abs(a * a + b * b - 1) <= 0.05)"""


def _solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = F.col("value"), F.col("event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    solved = GE.solve_two(v + 40, v / 2, v, v / 3, 3 * v, v / 4 + 20, 3 * v - 41 + e % 5, v / 5)
    return events.select("event_id", solved.alias("t")).where("t IS NOT NULL")


@query(f"{_SOLVED} SELECT event_id, round(a, 6) AS a, round(b, 6) AS b, round(tx, 4) AS tx, round(ty, 4) AS ty FROM t")
def q_two_point_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _solved(spark, sf_dir).select("event_id", "t.*")
    return df.select("event_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("tx", 4).alias("tx"), F.round("ty", 4).alias("ty"))


@query(
    f"""{_SOLVED}, i AS (SELECT *, a / (a * a + b * b) AS ia, -b / (a * a + b * b) AS ib FROM t), j AS (SELECT *, -(ia * tx - ib * ty) AS itx, -(ib * tx + ia * ty) AS ity FROM i)
SELECT event_id, round(atan2(b, a), 6) AS theta, round(sqrt(a * a + b * b), 6) AS scale, round(a * 3 - b * 4 + tx, 4) AS x, round(b * 3 + a * 4 + ty, 4) AS y, round(ia, 6) AS ia, round(itx, 4) AS itx, round(ity, 4) AS ity FROM j"""
)
def q_affine_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle, scale, a point moved forward, and the inverse of each transform."""
    t = F.col("t")
    point, back = GE.forward(t, F.lit(3.0), F.lit(4.0)), GE.inverse(t)
    return _solved(spark, sf_dir).select(
        "event_id", F.round(GE.angle(t), 6).alias("theta"), F.round(GE.scale(t), 6).alias("scale"), F.round(point["x"], 4).alias("x"), F.round(point["y"], 4).alias("y"), F.round(back["a"], 6).alias("ia"), F.round(back["tx"], 4).alias("itx"), F.round(back["ty"], 4).alias("ity")
    )


@query(f"""{_SOLVED}, v AS (SELECT event_id % 20 AS grp, round(tx / 3)::BIGINT AS vx, round(ty / 3)::BIGINT AS vy, round(atan2(b, a) / 0.005)::BIGINT AS va, count(*) AS votes FROM t GROUP BY ALL)
SELECT grp, vx, vy, va, votes FROM v QUALIFY row_number() OVER (PARTITION BY grp ORDER BY votes DESC, vx, vy, va) = 1""")
def q_transform_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _solved(spark, sf_dir).select((F.col("event_id") % 20).alias("grp"), F.col("t.tx").alias("tx"), F.col("t.ty").alias("ty"), GE.angle(F.col("t")).alias("theta"))
    return M.vote(t, ["grp"])


#: Peaks of an image twenty pixels apart, and the same turned and shifted: a transform that triangles must find.
_TURN = (0.8, 0.6, 31.0, -17.0)


@query(
    f"""{_MAXIMA}, peaks AS (SELECT vec_id, count(*) AS n FROM maxima GROUP BY 1)
SELECT vec_id, {_TURN[0]}::DOUBLE AS a, {_TURN[1]}::DOUBLE AS b, {_TURN[2]}::DOUBLE AS tx, {_TURN[3]}::DOUBLE AS ty, n::INT AS inliers FROM peaks WHERE n >= 6"""
)
def q_triangle_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform from each image's peaks to a turned copy of them, by triangles; images of fewer than six peaks have none."""
    peaks = _peaks(spark, sf_dir).withColumns({c: F.col(c) * 20.0 for c in "xy"}).drop("v")
    a, b, tx, ty = _TURN
    copy = peaks.select("vec_id", "star_id", (a * F.col("x") - b * F.col("y") + tx).alias("x"), (b * F.col("x") + a * F.col("y") + ty).alias("y"))
    left, right = (df.select("vec_id", "star_id", "x", "y").toDF("vec_id", "star_id", "x", "y") for df in (peaks, copy))
    found = R.triangle_transforms(left, right, "vec_id")
    return rounded(found)


def q_star_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted profiles of the stars of ``q_detected_stars``."""
    return rounded(S.star_profiles(_luma(spark, sf_dir)))


def q_phase_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift of every odd image against the even one before it."""
    df = images(spark, sf_dir).withColumn("pair", F.floor(F.col("vec_id") / 2))
    left = df.where("vec_id % 2 = 0").select("pair", F.col("pixels").alias("reference"))
    right = df.where("vec_id % 2 = 1").select("pair", F.col("pixels").alias("target"))
    return R.phase_shift(left.join(right, "pair").withColumns({"width": F.lit(SIDE), "height": F.lit(SIDE)}), "pair")


def q_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of every even image matched to free peaks of the next within three pixels."""
    p = _peaks(spark, sf_dir).withColumn("pair", F.floor(F.col("vec_id") / 2))
    return R.one_to_one(p.where("vec_id % 2 = 0").drop("vec_id"), p.where("vec_id % 2 = 1").drop("vec_id"), "pair", 3.0)


def _contributed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = images(spark, sf_dir).withColumn("filter", F.when(F.col("vec_id") % 13 == 4, "L").when(F.col("vec_id") % 3 > 0, " ha").otherwise("Ha"))
    first = df.groupBy("label").agg(F.min(F.when(F.col("filter") != "L", F.col("vec_id"))).alias("vec_id"))
    return df, R.contributions(df, first, "label", "vec_id", SIDE, SIDE)


def q_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every image enters the stack of its label: filter, background, shift against the label's first image."""
    return rounded(_contributed(spark, sf_dir)[1])


def q_stack_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of each label registered to the label's first and combined, those of another filter left out."""
    df, contributed = _contributed(spark, sf_dir)
    return rounded(R.stack_frames(df, contributed, "label", "vec_id", SIDE, SIDE, crop=False))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 64 embeddings as the rows of an image of 64 by 64 samples with stars in it (``sky``), a colour mosaic for every second image; rows that lack are grey."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.groupBy(F.floor(F.col("vec_id") / 64).alias("frame_id")).agg(F.array_sort(F.collect_list(F.struct((F.col("vec_id") % 64).alias("y"), "embedding"))).alias("rows"))  # 64 rows a group
    flat = F.flatten(F.transform(F.col("rows"), lambda r: F.transform(r["embedding"], lambda e: ((e + 1) / 2).cast("float"))))
    filled = F.slice(F.concat(flat, F.array_repeat(F.lit(0.5).cast("float"), 4096)), 1, 4096)
    mosaic = F.col("frame_id") % 2 == 1
    keywords = F.when(mosaic, F.create_map(F.lit("BAYERPAT"), F.struct(F.lit("RGGB").alias("value"), F.lit(None).cast("string").alias("comment")))).otherwise(F.create_map().cast("map<string, struct<value: string, comment: string>>"))
    side = {c: F.lit(64) for c in ("width", "height")}
    tiles = rows.select("frame_id", F.concat(F.lit("night "), (F.col("frame_id") % 2).cast("string")).alias("session"), filled.alias("tile"), keywords.alias("keywords"))
    skies = FR.map_frames(tiles, tiles.drop("tile").columns, ["tile"], lambda v: (sky(v.reshape(64, 64).astype(float)).astype(np.float32).ravel(),), "pixels array<float>")
    return skies.withColumns(
        side | {"channels": F.lit(1), "bit_depth": F.lit("f32"), "color_space": F.when(mosaic, "Bayer").otherwise("Mono"), "path": F.col("frame_id").cast("string"), "error": F.lit(None).cast("string")}
    )


def star_places(tile: np.ndarray) -> list[tuple[int, int, float]]:
    """(x, y, amplitude) of the stars of a tile: the largest sample of each of nine squares of 16 by 16, which is the star's brightness too."""
    places = []
    for top in (4, 24, 44):
        for left in (4, 24, 44):
            square = tile[top : top + 16, left : left + 16]
            j, i = divmod(int(square.argmax()), 16)
            places.append((left + i, top + j, min(max(1.2 * (2 * square.max() - 1), 0.05), 0.8)))
    return places


def sky(tile: np.ndarray) -> np.ndarray:
    """Stars at a tile's places over a background that its samples ripple; how wide they are is told by its first sample."""
    y, x = np.mgrid[: tile.shape[0], : tile.shape[1]]
    return 0.05 + 0.004 * (tile - 0.5) + sum(v * (1 + ((x - i) ** 2 + (y - j) ** 2) / (2 + 2 * tile[0, 0]) ** 2) ** -S.EXPONENT for i, j, v in star_places(tile))


def q_analyze_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From images to verdicts: luminance, background, stars, medians, two-pass statistics, classes, reference frames."""
    out = FR.analyze_images(_tiles(spark, sf_dir), "session", "frame_id")
    return rounded(out.withColumn("triggered_by", F.array_join("triggered_by", ",")))


def _luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.load(_tiles(spark, sf_dir), "luma", ["frame_id", "width", "height"]).select(F.col("frame_id").alias("frame"), "width", "height", F.col("loaded").alias("luma"))


def q_detected_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars of the images of ``q_analyze_images`` with their overlay circles' radius."""
    return rounded(S.detect_stars(_luma(spark, sf_dir)).withColumn("r", F.col("fwhm") / 2))


#: How the copies of a sky are moved (turn, shift) before they are registered and stacked; the last is of another filter.
COPIES = ((0.0, 0.0, 0.0, "Ha"), (0.0, 2.0, -1.0, " ha"), (0.012, -1.5, 2.0, None), (0.0, 1.0, 1.0, "OIII"))


def _copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every sky of ``q_detected_stars`` in copies (tile, copy, filter, pixels), and how they enter the sky's stack, by their stars."""
    skies = _luma(spark, sf_dir).select(F.col("frame").alias("tile"), F.col("luma").alias("pixels"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("copy"), F.lit(c[3]).cast("string").alias("filter"), *(F.lit(float(v)).alias(n) for n, v in zip(("a", "b", "tx", "ty"), (math.cos(c[0]), math.sin(c[0]), *c[1:3]), strict=True))) for k, c in enumerate(COPIES))))
    spread = skies.withColumn("c", each).select("tile", "pixels", "c.*")
    moved = materialised(FR.resample_frames(spread, ["tile", "copy", "filter"], ["a", "b", "tx", "ty"], 64, 64))
    found = S.detect_stars(moved.select(F.concat_ws("/", "tile", "copy").alias("frame"), F.lit(64).alias("width"), F.lit(64).alias("height"), F.col("pixels").alias("luma")))
    name = F.split("frame", "/")
    stars = materialised(found.select(name[0].cast("long").alias("tile"), name[1].cast("int").alias("copy"), "star_id", F.col("cx").alias("x"), F.col("cy").alias("y")))
    first = skies.select("tile", F.lit(0).alias("copy"))
    return moved, R.contributions(moved, first, "tile", "copy", 64, 64, stars)


def q_star_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How moved and turned copies of each sky enter its stack: by matched stars, another filter left out."""
    return rounded(_copies(spark, sf_dir)[1])


def q_star_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of each sky registered by their stars, moved back, combined and cropped to what all cover."""
    moved, contributed = _copies(spark, sf_dir)
    return rounded(R.stack_frames(moved, contributed, "tile", "copy", 64, 64))


#: Walks over whole images or over matches in order, which SQL cannot say; tests hold them against known shifts and loops.
QUERIES |= {f.__name__: f for f in (q_phase_shift, q_one_to_one, q_contributions, q_stack_frames, q_star_contributions, q_star_stacks, q_analyze_images, q_detected_stars, q_star_profiles)}
