"""Queries on images: array functions, mosaics, stretches, histograms, stacking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.functions import arrays as A
from framesieve.operators import frames as FR
from framesieve.operators import registration as R
from framesieve.operators import stacking as ST
from framesieve.operators import tiles as TI
from framesieve.plans import sql
from framesieve.plans.session_queries import rounded
from framesieve.sources.adapters import SIDE, images, pixels

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
PX = f"WITH {sql.PIXELS}"


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _long(df: DataFrame, column: str, name: str = "v") -> DataFrame:
    """One row per element of an array column."""
    return df.select("vec_id", F.posexplode(column).alias("i", name))


@query(f"{PX} SELECT vec_id, i, round(floor(v * 65535)::INT / 65535.0, 6) AS v FROM pixels")
def q_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit samples as fractions."""
    raw = images(spark, sf_dir).select("vec_id", F.transform("pixels", lambda v: F.floor(v * 65535).cast("int")).alias("raw"))
    return rounded(_long(raw.select("vec_id", A.normalize(F.col("raw"), "u16").alias("v")), "v"))


@query(f"{PX}, c AS (SELECT vec_id, i // 3 AS p, i % 3 AS ch, v FROM pixels WHERE i < 63) SELECT vec_id, p::INT AS i, round(sum(v * [0.299, 0.587, 0.114][ch + 1]), 6) AS luma FROM c GROUP BY 1, 2")
def q_luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved colour (21 pixels of 3 samples) to luminance."""
    df = images(spark, sf_dir).select("vec_id", F.slice("pixels", 1, 63).alias("rgb"))
    return rounded(_long(df.select("vec_id", A.luminance(F.col("rgb"), 3).alias("luma")), "luma", "luma"))


_MOSAIC = f"""{PX}, n AS (SELECT p.vec_id, p.i, p.x, p.y, p.v, d.dx, d.dy, CASE WHEN p.x + d.dx < 0 THEN 1 WHEN p.x + d.dx > 7 THEN 6 ELSE p.x + d.dx END AS nx,
  CASE WHEN p.y + d.dy < 0 THEN 1 WHEN p.y + d.dy > 7 THEN 6 ELSE p.y + d.dy END AS ny FROM pixels p
  CROSS JOIN (SELECT a.d AS dx, b.d AS dy FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b) d), c AS (
  SELECT n.vec_id, n.i, n.x, n.y, n.v AS own, CASE WHEN n.x % 2 = 0 AND n.y % 2 = 0 THEN 'R' WHEN n.x % 2 = 1 AND n.y % 2 = 1 THEN 'B' ELSE 'G' END AS k,
    avg(q.v) FILTER (abs(dx) + abs(dy) = 2) AS corners, avg(q.v) FILTER (abs(dx) + abs(dy) = 1) AS crossed, avg(q.v) FILTER (dy = 0 AND dx <> 0) AS beside, avg(q.v) FILTER (dx = 0 AND dy <> 0) AS above
  FROM n JOIN pixels q ON q.vec_id = n.vec_id AND q.x = n.nx AND q.y = n.ny GROUP BY ALL), rgb AS (
  SELECT vec_id, i, CASE k WHEN 'R' THEN own WHEN 'B' THEN corners ELSE CASE WHEN y % 2 = 0 THEN beside ELSE above END END AS r,
    CASE k WHEN 'G' THEN own ELSE crossed END AS g, CASE k WHEN 'B' THEN own WHEN 'R' THEN corners ELSE CASE WHEN y % 2 = 1 THEN beside ELSE above END END AS b FROM c)"""


@query(f"{_MOSAIC} SELECT vec_id, i, round(greatest(0, least(1, r)), 6) AS r, round(greatest(0, least(1, g)), 6) AS g, round(greatest(0, least(1, b)), 6) AS b FROM rgb")
def q_debayer(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = FR.debayer_frames(images(spark, sf_dir), ["vec_id"], SIDE, SIDE)
    return rounded(_long(planes.select("vec_id", F.arrays_zip("r", "g", "b").alias("rgb")), "rgb", "p").select("vec_id", "i", "p.r", "p.g", "p.b"))


@query(f"{_MOSAIC} SELECT vec_id, i, round(0.299 * greatest(0, least(1, r)) + 0.587 * greatest(0, least(1, g)) + 0.114 * greatest(0, least(1, b)), 6) AS luma FROM rgb")
def q_debayer_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_long(FR.debayer_luma_frames(images(spark, sf_dir), ["vec_id"], SIDE, SIDE), "luma", "luma"))


@query(
    f"""{PX}, f AS (SELECT label, i, avg(v) AS f FROM pixels GROUP BY ALL), m AS (SELECT label, avg(f) AS m FROM f GROUP BY 1)
SELECT vec_id, p.i, round(v / greatest(f / m, 0.1), 6) AS v FROM pixels p JOIN f ON f.label = p.label AND f.i = p.i JOIN m ON m.label = p.label"""
)
def q_flat_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image over the mean image of its label."""
    means = TI.stack_arrays(images(spark, sf_dir), ["label"], clip=1e9)
    flats = TI.whole_images(means, ["label"], SIDE).select("label", F.col("pixels").alias("flat"))
    joined = images(spark, sf_dir).join(flats, "label")
    return rounded(_long(joined.select("vec_id", A.flat_divide(F.col("pixels"), F.col("flat")).alias("v")), "v"))


def _clip_rounds(sigma: float, rounds: int, last: str = "pixels", shown: str = "count(*) AS kept") -> str:
    parts = []
    for k in range(rounds):
        parts.append(f"""r{k} AS (SELECT p.vec_id, p.v FROM {last} p JOIN (SELECT vec_id, median(v) AS m, stddev_pop(v) AS d FROM {last} GROUP BY 1) s ON s.vec_id = p.vec_id
  WHERE d <= 0 OR v BETWEEN m - {sigma} * d AND m + {sigma} * d)""")
        last = f"r{k}"
    return ", ".join(parts) + f" SELECT vec_id, round(median(v), 6) AS background, round(stddev_pop(v), 6) AS sigma, {shown} FROM {last} GROUP BY 1"


@query(f"{PX}, {_clip_rounds(1.5, 5)}")
def q_sigma_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background and its deviation after five rounds of clipping at 1.5 deviations."""
    df = images(spark, sf_dir).select("vec_id", A.sigma_clip(F.col("pixels"), 1.5).alias("kept"))
    return rounded(df.select("vec_id", A.median(F.col("kept")).alias("background"), A.population_sigma(F.col("kept")).alias("sigma"), F.size("kept").cast("long").alias("kept")))


@query(f"{PX}, every2 AS (SELECT vec_id, v FROM pixels WHERE i % 2 = 0), {_clip_rounds(1.2, 4, 'every2', 'round(median(v) * 65535)::BIGINT AS adu')}")
def q_background_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of every second pixel after four rounds of clipping at 1.2 deviations, as a fraction and in 16-bit units."""
    df = images(spark, sf_dir).select("vec_id", A.background(A.subsample(F.col("pixels"), 2), 1.2, 4).alias("b"))
    return rounded(df.select("vec_id", F.col("b.median").alias("background"), F.col("b.sigma").alias("sigma"), F.round(F.col("b.median") * 65535).cast("long").alias("adu")))


@query(f"{PX} SELECT vec_id, round(avg(CASE WHEN v >= 0.6 THEN 1.0 ELSE 0.0 END), 6) AS clipped FROM pixels GROUP BY 1")
def q_highlight_clipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(images(spark, sf_dir).select("vec_id", A.clipped_fraction(F.col("pixels"), 0.6).alias("clipped")))


_STF = f"""{PX}, o AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS k FROM pixels), m AS (SELECT vec_id, v AS m FROM o WHERE k = 33), d AS (
  SELECT p.vec_id, abs(v - m) AS a, row_number() OVER (PARTITION BY p.vec_id ORDER BY abs(v - m)) AS k FROM pixels p JOIN m ON m.vec_id = p.vec_id), c AS (
  SELECT m.vec_id, greatest(0, least(1, m - 1.4826 * 2.8 * a)) AS c0 FROM m JOIN d ON d.vec_id = m.vec_id AND k = 33), l AS (
  SELECT p.vec_id, c0, (v - c0) / (1 - c0) AS q FROM pixels p JOIN c ON c.vec_id = p.vec_id WHERE v > c0), lr AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q) AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM l), stf AS (
  SELECT vec_id, c0 AS shadow, CASE WHEN q = 0.5 THEN 0.15 ELSE (q - 1) * 0.15 / ((2 * q - 1) * 0.15 - q) END AS midtone FROM lr WHERE k = n // 2 + 1)"""


@query(f"{_STF} SELECT vec_id, round(shadow, 6) AS shadow, round(midtone, 6) AS midtone FROM stf")
def q_stretch_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = images(spark, sf_dir).select("vec_id", A.stretch_parameters(F.col("pixels")).alias("s"))
    return rounded(df.select("vec_id", "s.shadow", "s.midtone"))


@query(
    f"""{_STF}, s AS (SELECT p.vec_id, i, greatest(0, least(1, (v - shadow) / (1 - shadow))) AS x, midtone AS m FROM pixels p JOIN stf ON stf.vec_id = p.vec_id)
SELECT vec_id, i, round(CASE WHEN x <= 0 THEN 0 WHEN x >= 1 THEN 1 WHEN m = 0.5 THEN x ELSE (m - 1) * x / ((2 * m - 1) * x - m) END, 6) AS v FROM s"""
)
def q_auto_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = images(spark, sf_dir).select("vec_id", "pixels", A.stretch_parameters(F.col("pixels")).alias("s"))
    return rounded(_long(df.select("vec_id", A.stretch(F.col("pixels"), F.col("s")).alias("v")), "v"))


_STACK_STF = f"""WITH {sql.PIXELS.replace("pixels AS", "single AS", 1)}, pixels AS (SELECT label AS vec_id, i, avg(v) AS v FROM single GROUP BY ALL){_STF.removeprefix(PX)}"""


@query(
    f"""{_STACK_STF}, s AS (SELECT p.vec_id, i, greatest(0, least(1, (v - shadow) / (1 - shadow))) AS x, midtone AS m FROM pixels p JOIN stf ON stf.vec_id = p.vec_id)
SELECT vec_id AS label, i, round(CASE WHEN x <= 0 THEN 0 WHEN x >= 1 THEN 1 WHEN m = 0.5 THEN x ELSE (m - 1) * x / ((2 * m - 1) * x - m) END, 6) AS v FROM s"""
)
def q_stretched_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean image of each label as one image, its stretch kept."""
    means = TI.stack_arrays(images(spark, sf_dir), ["label"], clip=1e9)
    kept = FR.stretch_images(TI.whole_images(means, ["label"], SIDE), ["label"], F.lit(1))
    return rounded(kept.select("label", F.posexplode("pixels").alias("i", "v")))


@query(f"{PX} SELECT vec_id, i, floor(greatest(0, least(1, v)) * 255)::INT AS v FROM pixels")
def q_to_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(images(spark, sf_dir).select("vec_id", A.to_byte(F.col("pixels")).alias("v")), "v")


@query(f"{PX}, b AS (SELECT label, floor(v * 255)::INT AS bin, count(*) AS n FROM pixels GROUP BY ALL) SELECT l.label, g.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT label FROM b) l CROSS JOIN (SELECT unnest(range(256))::INT AS bin) g LEFT JOIN b ON b.label = l.label AND b.bin = g.bin")
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """256 bins for each label."""
    return ST.histogram(pixels(spark, sf_dir), "label")


@query(f"{PX} SELECT label, round(median(v), 6) AS median, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sigma, round(100.0 * count(*) FILTER (v >= 0.6) / count(*), 6) AS clipped FROM pixels WHERE i % 16 = 0 GROUP BY 1")
def q_histogram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, mean, deviation and clipped share of every sixteenth sample."""
    return rounded(ST.histogram_statistics(pixels(spark, sf_dir).where(F.col("i") % ST.HISTOGRAM_STEP == 0), "label", clip=0.6))


@query(f"{PX}, h AS (SELECT *, (vec_id + i) % 5 = 0 OR (vec_id % 4 = 1 AND x < 3 AND y < 3) AS hole FROM pixels) SELECT vec_id, 3::INT AS step, ((y // 3) * 2 + x // 3)::INT AS i, round(coalesce(avg(v) FILTER (NOT hole), 0), 6) AS v FROM h WHERE x < 6 AND y < 6 GROUP BY ALL")
def q_box_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with holes reduced to a width of at most three pixels: the step follows from the width, holes do not count, a block of holes is 0."""
    key, side = F.col("vec_id"), {c: F.lit(n) for c, n in (("width", SIDE), ("height", SIDE), ("channels", 1))}
    hole = lambda v, i: F.when(((key + i) % 5 == 0) | ((key % 4 == 1) & (i % SIDE < 3) & (i < 3 * SIDE)), float("nan")).otherwise(v)
    holes = images(spark, sf_dir).withColumn("pixels", F.transform("pixels", hole)).withColumns(side)
    return rounded(FR.reduce_images(holes, ["vec_id"], 3).select("vec_id", "step", F.posexplode("reduced").alias("i", "v")))


_COLOUR = f"""{PX.replace("pixels AS", "single AS", 1)}, pixels AS (SELECT (vec_id // 3) * 3 + vec_id % 3 AS vec_id, ((y // 2) * 4 + x // 2)::INT AS i, avg(v) AS v FROM single GROUP BY ALL){_STF.removeprefix(PX).replace("k = 33", "k = 9")}"""


@query(
    f"""{_COLOUR}, s AS (SELECT p.vec_id, i, greatest(0, least(1, (v - shadow) / (1 - shadow))) AS x, midtone AS m FROM pixels p JOIN stf ON stf.vec_id = p.vec_id), w AS (SELECT vec_id // 3 AS g FROM single GROUP BY 1 HAVING count(DISTINCT vec_id) = 3)
SELECT vec_id // 3 AS image, i, (vec_id % 3)::INT AS channel, round(CASE WHEN x <= 0 THEN 0 WHEN x >= 1 THEN 1 WHEN m = 0.5 THEN x ELSE (m - 1) * x / ((2 * m - 1) * x - m) END, 6) AS v FROM s JOIN w ON g = vec_id // 3"""
)
def q_display_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three images as the channels of one, reduced to four pixels a side and each channel stretched by its own parameters."""
    planes = images(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 3).alias("image")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "pixels"))).alias("p")).where(F.size("p") == 3)  # three rows a group
    colour = planes.withColumn("pixels", A.planar_to_interleaved(F.flatten(F.col("p.pixels")), 3)).withColumns({"width": F.lit(SIDE), "height": F.lit(SIDE), "channels": F.lit(3), "bit_depth": F.lit("f32")})
    shown = FR.auto_stretch_images(colour.drop("p"), ["image"], 4).select("image", F.posexplode("stretched").alias("k", "v"))
    return rounded(shown.select("image", F.expr("k div 3").cast("int").alias("i"), (F.col("k") % 3).alias("channel"), "v"))


@query(
    f"""{PX}, o AS (SELECT vec_id, i, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) - 1 AS k FROM pixels), s AS (SELECT vec_id, max(v) FILTER (k = 3) AS lo, max(v) FILTER (k = 60) AS hi FROM o GROUP BY 1)
SELECT p.vec_id, i, round(greatest(0, least(1, (v - lo) / greatest(hi - lo, 1e-6))), 6) AS v FROM pixels p JOIN s ON s.vec_id = p.vec_id"""
)
def q_percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the 5th and 95th percentiles by nearest rank."""
    return rounded(_long(images(spark, sf_dir).select("vec_id", A.percentile_stretch(F.col("pixels"), 5, 95).alias("v")), "v"))


_CHANNELS = f"{PX.replace('pixels AS', 'single AS', 1)}, pixels AS (SELECT vec_id * 3 + i % 3 AS vec_id, v FROM single WHERE i < 63 AND (i // 3) % 2 = 0)"


@query(f"{_CHANNELS}, lv AS ({_clip_rounds(1.5, 5).join(['WITH ', '']).replace('round(median(v), 6) AS background', 'median(v) AS m')}) SELECT vec_id // 3 AS vec_id, (vec_id % 3)::INT AS channel, round(CASE WHEN min(m) OVER w > 1.1920929e-07 THEN avg(m) OVER w / m ELSE 1 END, 6) AS coefficient FROM lv WINDOW w AS (PARTITION BY vec_id // 3)")
def q_channel_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What balances the channels of each image (21 pixels of 3 samples), from the clipped medians of every second pixel."""
    df = images(spark, sf_dir).select("vec_id", F.slice("pixels", 1, 63).alias("pixels"))
    return rounded(FR.balance_images(df, ["vec_id"], 2, 1.5))


@query(
    f"""{PX}, b AS (SELECT label, i, avg(v) AS v FROM pixels GROUP BY ALL), o AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY v) - 1 AS k FROM b), s AS (SELECT label, max(v) FILTER (k = 0) AS lo, max(v) FILTER (k = 63) AS hi FROM o GROUP BY 1)
SELECT b.label, i, round(greatest(0, least(1, (v - lo) / greatest(hi - lo, 1e-6))), 6) AS v FROM b JOIN s ON s.label = b.label"""
)
def q_finished_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean image of each label as a stack is kept: brought to 0..1 from its low and high percentiles."""
    stacks = TI.whole_images(TI.stack_arrays(images(spark, sf_dir), ["label"], clip=1e9), ["label"], SIDE)
    return rounded(FR.finish_stacks(stacks, ["label"]).select("label", F.posexplode("pixels").alias("i", "v")))


@query(f"{PX}, b AS (SELECT vec_id, label, vec_id % 4 AS x0, vec_id % 3 AS y0, 8 - vec_id % 5 AS x1, 8 - vec_id % 2 AS y1 FROM embeddings), o AS (SELECT label, max(x0) AS x0, max(y0) AS y0, min(x1) AS x1, min(y1) AS y1 FROM b GROUP BY 1) SELECT vec_id, p.x, p.y, round(v, 6) AS v FROM pixels p JOIN o ON o.label = p.label WHERE p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1")
def q_overlap_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels inside the rectangle that all images of a label cover."""
    key = F.col("vec_id")
    bounds = images(spark, sf_dir).select("label", (key % 4).alias("x0"), (key % 3).alias("y0"), (8 - key % 5).alias("x1"), (8 - key % 2).alias("y1"))
    joined = pixels(spark, sf_dir).join(ST.overlap(bounds, "label"), "label")
    return rounded(joined.where("x >= x0 AND x < x1 AND y >= y0 AND y < y1").select("vec_id", "x", "y", "v"))


@query(f"{PX} SELECT vec_id, i, round((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 6) AS v FROM pixels WINDOW w AS (PARTITION BY vec_id)")
def q_min_max_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_long(images(spark, sf_dir).select("vec_id", A.min_max(F.col("pixels")).alias("v")), "v"))


@query(f"{PX} SELECT vec_id, ((i % 21) * 3 + i // 21)::INT AS i, round(v, 6) AS v FROM pixels WHERE i < 63")
def q_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three planes of 21 samples to interleaved ones."""
    df = images(spark, sf_dir).select("vec_id", A.planar_to_interleaved(F.slice("pixels", 1, 63), 3).alias("v"))
    return rounded(_long(df, "v"))


@query(f"{PX} SELECT vec_id, round(v, 4) AS raw, floor(v * 65535)::BIGINT AS adu FROM pixels WHERE x = vec_id % 8 AND y = 5")
def q_pixel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.pixel_at(F.col("pixels"), F.col("vec_id") % 8, 5, SIDE)
    return images(spark, sf_dir).select("vec_id", F.round(v, 4).alias("raw"), F.floor(v * 65535).alias("adu"))


@query(f"{PX} SELECT label, x, y, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sigma FROM pixels GROUP BY ALL")
def q_pixel_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ST.pixel_statistics(pixels(spark, sf_dir), ["label", "x", "y"]))


@query(
    f"""{PX}, s AS (SELECT label, x, y, avg(v) AS m, coalesce(stddev_samp(v), 0) AS d FROM pixels GROUP BY ALL)
SELECT p.label, p.x, p.y, count(*) AS n, count(*) FILTER (d < 1e-10 OR abs(v - m) <= 1.5 * d) AS kept, round(coalesce(avg(v) FILTER (d < 1e-10 OR abs(v - m) <= 1.5 * d), 0), 6) AS stacked
FROM pixels p JOIN s ON s.label = p.label AND s.x = p.x AND s.y = p.y GROUP BY ALL"""
)
def q_clipped_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a label stacked, each pixel's mean taken within 1.5 deviations."""
    rows = TI.pixel_rows(TI.stack_arrays(images(spark, sf_dir), ["label"], clip=1.5), ["label"], ["n", "kept", "stacked"])
    return rounded(rows.select("label", (F.col("i") % SIDE).cast("int").alias("x"), F.expr(f"i div {SIDE}").cast("int").alias("y"), F.col("n").cast("long").alias("n"), F.col("kept").cast("long").alias("kept"), "stacked"))


@query(
    f"""{PX}, c AS (SELECT vec_id, label, i // 3 AS p, max(v) FILTER (i % 3 = 0) AS r, max(v) FILTER (i % 3 = 1) AS g, max(v) FILTER (i % 3 = 2) AS b FROM pixels WHERE i < 63 GROUP BY ALL), s AS (
  SELECT label, p, avg(g) AS m, coalesce(stddev_samp(g), 0) AS d FROM c GROUP BY ALL), k AS (SELECT c.*, d < 1e-10 OR abs(g - m) <= 2.5 * d AS near FROM c JOIN s ON s.label = c.label AND s.p = c.p)
SELECT label, p::INT AS p, count(*) FILTER (near) AS kept, round(coalesce(avg(r) FILTER (near), 0), 6) AS r, round(coalesce(avg(g) FILTER (near), 0), 6) AS g, round(coalesce(avg(b) FILTER (near), 0), 6) AS b FROM k GROUP BY 1, 2"""
)
def q_clipped_mean_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour: the green sample decides for all three."""
    rgb = images(spark, sf_dir).select("label", F.slice("pixels", 1, 63).alias("pixels"))
    rows = TI.pixel_rows(TI.stack_arrays(rgb, ["label"], channels=3), ["label"], ["kept"], {"r": 0, "g": 1, "b": 2})
    return rounded(rows.select("label", F.col("i").cast("int").alias("p"), F.col("kept").cast("long").alias("kept"), "r", "g", "b"))


@query(f"{PX}, s AS (SELECT label, x, y, count(*) FILTER (v > 0.6) AS n FROM pixels GROUP BY ALL) SELECT label, count(*) FILTER (n < 2) AS low FROM s GROUP BY 1")
def q_low_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = pixels(spark, sf_dir).groupBy("label", "x", "y").agg(F.count(F.when(F.col("v") > 0.6, 1)).alias("n"))
    return covered.groupBy("label").agg(ST.low_coverage(covered).alias("low"))


@query(
    f"""{PX}, a AS (SELECT vec_id, x, y, x - (0.25 + vec_id % 3) AS sx, y - (vec_id % 2 - 0.5) AS sy FROM pixels), c AS (
  SELECT a.vec_id, a.x, a.y, greatest(0, least(7, floor(sx) + i))::INT AS px, greatest(0, least(7, floor(sy) + j))::INT AS py,
    (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS w
  FROM a CROSS JOIN (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j))
SELECT c.vec_id, c.x, c.y, round(sum(v * w), 6) AS v FROM c JOIN pixels p ON p.vec_id = c.vec_id AND p.x = px AND p.y = py GROUP BY ALL"""
)
def q_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images moved by a shift of their own, bilinearly."""
    key = F.col("vec_id")
    moved = FR.resample_frames(images(spark, sf_dir), ["vec_id"], [F.lit(1.0), F.lit(0.0), F.lit(0.25) + key % 3, key % 2 - F.lit(0.5)], SIDE, SIDE)
    return rounded(ST.long_form(moved, ["vec_id"], SIDE))


_CORNERS = """c AS (SELECT a.vec_id, a.x, a.y, greatest(0, least(7, floor(sx) + i))::INT AS px, greatest(0, least(7, floor(sy) + j))::INT AS py,
    (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS w
  FROM a CROSS JOIN (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j))"""


@query(
    f"""{PX}, t AS (SELECT vec_id, cos((vec_id % 7) * 0.02) AS a, sin((vec_id % 7) * 0.02) AS b, vec_id % 3 - 0.7::DOUBLE AS tx, vec_id % 5 - 1.6::DOUBLE AS ty FROM embeddings), a AS (
  SELECT p.vec_id, x, y, (a * (x - tx) + b * (y - ty)) / (a * a + b * b) AS sx, (a * (y - ty) - b * (x - tx)) / (a * a + b * b) AS sy FROM pixels p JOIN t ON t.vec_id = p.vec_id), {_CORNERS}
SELECT c.vec_id, c.x, c.y, round(sum(v * w), 5) AS v FROM c JOIN pixels p ON p.vec_id = c.vec_id AND p.x = px AND p.y = py GROUP BY ALL"""
)
def q_resample_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images turned and moved by a transform of their own, bilinearly."""
    key = F.col("vec_id")
    turn = (key % 7) * 0.02
    moved = FR.resample_frames(images(spark, sf_dir), ["vec_id"], [F.cos(turn), F.sin(turn), key % 3 - F.lit(0.7), key % 5 - F.lit(1.6)], SIDE, SIDE)
    return rounded(ST.long_form(moved, ["vec_id"], SIDE), 5)


@query(
    f"""{PX}, t AS (SELECT vec_id, label, vec_id % 11 = 5 AS out, (vec_id % 3 - 1)::INT AS tx, (vec_id % 2)::INT AS ty FROM embeddings), g AS (SELECT vec_id, avg(v) AS level FROM pixels GROUP BY 1), m AS (
  SELECT t.label, p.x, p.y, q.v / level AS v FROM pixels p JOIN t ON t.vec_id = p.vec_id AND NOT out JOIN pixels q ON q.vec_id = p.vec_id AND q.x = greatest(0, least(7, p.x - tx)) AND q.y = greatest(0, least(7, p.y - ty)) JOIN g ON g.vec_id = p.vec_id), s AS (
  SELECT label, x, y, avg(v) AS m, coalesce(stddev_samp(v), 0) AS d FROM m GROUP BY ALL), o AS (
  SELECT label, max(greatest(0, tx)) AS x0, max(greatest(0, ty)) AS y0, min(least(8, 8 + tx)) AS x1, min(least(8, 8 + ty)) AS y1 FROM t WHERE NOT out GROUP BY 1)
SELECT m.label, m.x, m.y, count(*) AS n, count(*) FILTER (d < 1e-10 OR abs(v - m) <= 2.5 * d) AS kept, round(coalesce(avg(v) FILTER (d < 1e-10 OR abs(v - m) <= 2.5 * d), 0), 5) AS stacked
FROM m JOIN s ON s.label = m.label AND s.x = m.x AND s.y = m.y JOIN o ON o.label = m.label WHERE m.x >= x0 AND m.x < x1 AND m.y >= y0 AND m.y < y1 GROUP BY ALL"""
)
def q_stack_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a label over their backgrounds, moved by known whole pixels, combined and cropped to what all cover; some are excluded."""
    key, df = F.col("vec_id"), images(spark, sf_dir)
    level = A.mean(F.col("pixels"))
    one = F.lit(1.0)
    known = df.select("label", "vec_id", (key % 11 != 5).alias("included"), level.alias("background_level"), one.alias("a"), (one * 0).alias("b"), (key % 3 - 1).cast("double").alias("tx"), (key % 2).cast("double").alias("ty"))
    return rounded(R.stack_frames(df.select("label", "vec_id", "pixels"), known, "label", "vec_id", SIDE, SIDE), 5)


@query("SELECT label, sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings GROUP BY 1")
def q_memory_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the images of each label at 4 bytes a sample."""
    return images(spark, sf_dir).groupBy("label").agg(F.sum(A.array_bytes(F.col("pixels"))).alias("bytes"))
