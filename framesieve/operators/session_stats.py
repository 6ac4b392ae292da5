"""Session-relative statistics: means, bimodality, the valley of a histogram, and two-pass outlier clipping.

Every function takes the grouping column of a session, so any number of sessions is one plan; a
session's statistics are one row, joined back to its frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framesieve.operators.tables import small_table

#: Single-precision epsilon, the coefficient above which values count as bimodal, bins, and how deep a valley must be.
EPSILON, BIMODAL, BINS, DEPTH = 1.1920929e-07, 0.555, 20, 0.2
#: Frames further than so many standard deviations are left out of the second pass.
OUTLIER_SIGMA = 4.0
METRICS = ("background_median", "fwhm", "eccentricity", "star_count")


def mean_and_sigma(value: str, alias: str | None = None) -> list[Column]:
    """Mean and population standard deviation, 0 and 0 without values."""
    name = alias or value
    return [F.coalesce(F.avg(value), F.lit(0.0)).alias(f"{name}_mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias(f"{name}_sigma")]


def bimodality_coefficient(value: str) -> Column:
    """(skewness**2 + 1) / (excess kurtosis + 3 (n - 1)**2 / ((n - 2)(n - 3))); null for fewer than 4 values or no spread."""
    n = F.count(value).cast("double")
    bend = 3 * (n - 1) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when((n >= 4) & (F.var_pop(value) >= EPSILON), (F.skewness(value) * F.skewness(value) + 1) / (F.kurtosis(value) + bend))


def _ranges(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, low, high, many, bc): one row per group."""
    v = F.col(value).cast("double")
    return df.groupBy(by).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(value).alias("many"), bimodality_coefficient(value).alias("bc"))


def _binned(df: DataFrame, by: str, value: str, bins: int) -> DataFrame:
    """(by, low, width, bc, bin, n): two passes, one for the ranges, one that counts; every bin of a group is there."""
    ranged = _ranges(df, by, value).where((F.col("high") - F.col("low") >= EPSILON) & (F.col("many") >= 4)).withColumn("width", (F.col("high") - F.col("low")) / bins)
    joined = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v")).join(ranged.select(by, "low", "width", "bc"), by)
    placed = joined.withColumn("bin", F.least(F.floor((F.col("v") - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int"))
    counted = placed.groupBy(by, "low", "width", "bc", "bin").agg(F.count("*").alias("n"))
    rows = counted.groupBy(by, "low", "width", "bc").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"))
    every = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(b.alias("bin"), F.coalesce(F.try_element_at("counts", b), F.lit(0)).cast("long").alias("n")))
    return rows.select(by, "low", "width", "bc", F.explode(every).alias("b")).select(by, "low", "width", "bc", "b.bin", "b.n")


def histogram(df: DataFrame, by: str, value: str, bins: int = BINS) -> DataFrame:
    """(by, low, width, bin, n) for every bin of every group with at least 4 values and some spread; the top value lies in the last bin."""
    return _binned(df, by, value, bins).drop("bc")


def _valleys(df: DataFrame, by: str, value: str, bins: int) -> DataFrame:
    """As ``valley``, with bc. Beyond the bins it works on ``bins`` rows a group."""
    order, group = W.partitionBy(by).orderBy("bin"), W.partitionBy(by)
    three = F.lag("n").over(order) + F.col("n") + F.lead("n").over(order)
    smooth = _binned(df, by, value, bins).withColumns({"whole": F.coalesce(F.floor(three / 3), F.col("n")), "exact": F.coalesce(three / 3, F.col("n").cast("double"))})
    half, height = F.col("bin") < bins // 2, F.struct("whole", "bin", "exact")
    peaks = smooth.withColumns({"first": F.max(F.when(half, height)).over(group), "second": F.max(F.when(~half, height)).over(group)})
    between = peaks.where((F.col("bin") >= F.col("first.bin")) & (F.col("bin") <= F.col("second.bin")))
    found = between.groupBy(by, "low", "width", "bc", "first", "second").agg(F.min(height).alias("least"))
    smaller = F.least(F.col("first.exact"), F.col("second.exact"))
    return found.select(
        by,
        F.col("first.bin").alias("peak1"),
        F.col("second.bin").alias("peak2"),
        F.col("least.bin").alias("valley_bin"),
        (F.col("low") + (F.col("least.bin") + 0.5) * F.col("width")).alias("valley"),
        F.when(smaller > EPSILON, F.col("least.exact") / smaller).otherwise(1.0).alias("depth"),
        "bc",
    )


def valley(df: DataFrame, by: str, value: str, bins: int = BINS) -> DataFrame:
    """(by, peak1, peak2, valley_bin, valley, depth): the deepest bin between the tallest bin of each half.

    Bins are smoothed with their neighbours (whole numbers; the outer two stay). Of equal peaks the last
    counts, of equal valleys the first. depth is the valley's height over the lower peak's.
    """
    return _valleys(df, by, value, bins).drop("bc")


def _with_cut(df: DataFrame, by: str, value: str) -> DataFrame:
    """df with ``_cut``: the value at which a clear valley parts two clusters of its group, or null."""
    cuts = _valleys(df, by, value, BINS).where((F.col("bc") > BIMODAL) & (F.col("depth") <= DEPTH)).select(by, F.col("valley").alias("_cut"))
    return df.join(small_table(cuts), by, "left")


def _anchored(value: str, higher_is_better: bool) -> list[Column]:
    """Aggregates over rows with ``_cut``: mean and sigma of the better cluster if it has two values or more, else of all; whether it has."""
    better = F.when(F.col(value) > F.col("_cut") if higher_is_better else F.col(value) < F.col("_cut"), F.col(value))
    clear = F.count(better) >= 2
    return [
        F.coalesce(F.when(clear, F.avg(better)), F.avg(value), F.lit(0.0)).alias(f"{value}_mean"),
        F.coalesce(F.when(clear, F.stddev_pop(better)), F.stddev_pop(value), F.lit(0.0)).alias(f"{value}_sigma"),
        clear.alias("anchored"),
    ]


def anchored_stats(df: DataFrame, by: str, value: str, higher_is_better: bool = True) -> DataFrame:
    """(by, <value>_mean, <value>_sigma, anchored): of the better cluster where a clear valley parts two, else of all values."""
    return _with_cut(df.select(by, value), by, value).groupBy(by).agg(*_anchored(value, higher_is_better))


def session_stats(frames: DataFrame, by: str = "session") -> DataFrame:
    """One row per session: mean and sigma of each metric; the star count's are anchored to the clear cluster.

    Reads ``frames`` three times: ranges, bins, statistics.
    """
    cut = _with_cut(frames, by, "star_count")
    return cut.groupBy(by).agg(*(c for m in METRICS[:3] for c in mean_and_sigma(m)), *_anchored("star_count", True)[:2])


def deviation(value: Column, mean: Column, sigma: Column) -> Column:
    """(value - mean) / sigma, 0 without spread."""
    return F.when(sigma < EPSILON, 0.0).otherwise((value - mean) / F.when(sigma >= EPSILON, sigma))


def _outlier() -> Column:
    far = F.lit(False)
    for m in ("background_median", "fwhm", "star_count"):
        z = (F.col(m) - F.col(f"{m}_mean")) / F.when(F.col(f"{m}_sigma") > EPSILON, F.col(f"{m}_sigma"))
        far = far | F.coalesce(F.abs(z) > OUTLIER_SIGMA, F.lit(False))
    return far


def mark_outliers(frames: DataFrame, stats: DataFrame, by: str = "session") -> DataFrame:
    """frames with ``outlier``: background, FWHM or star count beyond OUTLIER_SIGMA of the first pass."""
    return frames.join(small_table(stats), by).withColumn("outlier", _outlier()).select(*frames.columns, "outlier")


def two_pass_stats(frames: DataFrame, by: str = "session") -> DataFrame:
    """One row per session: statistics without the outliers of the first pass; the star count keeps its first ones.

    A session of outliers alone keeps the first pass. ``frames`` is read once more than for the first
    pass; persist it if its metrics are dear. The first pass is computed once and, being small, broadcast to the second.
    """
    first = small_table(session_stats(frames, by))
    names = [c for c in first.columns if c != by]
    marked = frames.join(first, by).withColumn("_clean", ~_outlier())
    clean = [c for m in METRICS[:3] for c in (F.avg(F.when(F.col("_clean"), F.col(m))).alias(f"clean_{m}_mean"), F.stddev_pop(F.when(F.col("_clean"), F.col(m))).alias(f"clean_{m}_sigma"))]
    kept = F.count(F.when(F.col("_clean"), 1))
    joined = marked.groupBy(by, *names).agg(*clean, kept.alias("_kept"), F.count("*").alias("_all"))
    some = F.col("_kept") > 0
    pairs = [F.when(some, F.coalesce(f"clean_{m}_{s}", F.lit(0.0))).otherwise(F.col(f"{m}_{s}")).alias(f"{m}_{s}") for m in METRICS[:3] for s in ("mean", "sigma")]
    return joined.select(by, *pairs, "star_count_mean", "star_count_sigma", (F.col("_all") - F.col("_kept")).alias("outliers"))
