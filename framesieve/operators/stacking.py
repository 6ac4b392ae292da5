"""What a stack reports, and statistics of pixels in long form; ``tiles`` combines the frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesieve.operators.ranges import exact_median

def pixel_statistics(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, n, mean, sigma): over the frames at each pixel; the sample deviation, 0 for one frame."""
    return pixels.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sigma"))


#: From which fraction on a sample of each depth counts as clipped; samples between those that a histogram takes.
CLIPPED, HISTOGRAM_STEP = {"u8": 253 / 255, "u16": 65208 / 65535, "f32": 0.995}, 16


def histogram(pixels: DataFrame, by: str, value: str = "v", bins: int = 256) -> DataFrame:
    """(by, bin, n): how many fractions fall into each of ``bins``, cut off, empty ones too."""
    counted = pixels.groupBy(by, F.floor(F.col(value) * (bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = counted.select(by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counted, [by, "bin"], "left").select(by, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram_statistics(pixels: DataFrame, by: str, depth: str = "f32", value: str = "v", clip: float | None = None) -> DataFrame:
    """(by, median, mean, sigma, clipped): the population's deviation; clipped in percent, by the depth's level or a given one."""
    level = CLIPPED[depth] if clip is None else clip
    clipped = F.count(F.when(F.col(value) >= level, 1)) * 100.0 / F.count("*")
    others = pixels.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sigma"), clipped.alias("clipped"))
    return exact_median(pixels, [by], value).join(others, by).select(by, "median", "mean", "sigma", "clipped")


def low_coverage(stats: DataFrame) -> Column:
    """The number of pixels that fewer than two frames cover."""
    return F.count(F.when(F.col("n") < 2, 1))


def stack_summary(contributions: DataFrame, by: list[str]) -> DataFrame:
    """Counts of frames by outcome: contributions has included and exclusion_reason.

    snr is the square root of the stacked frames; success is their share of the frames that the filter did
    not rule out, 0 if it ruled out all.
    """
    stacked = F.count(F.when(F.col("included"), 1))
    filtered = F.count(F.when(~F.col("included") & (F.col("exclusion_reason") == "FilterMismatch"), 1))
    total = F.count("*")
    return contributions.groupBy(*by).agg(
        total.alias("total"),
        stacked.alias("stacked"),
        filtered.alias("filter_excluded"),
        F.count(F.when(~F.col("included") & (F.col("exclusion_reason") != "FilterMismatch"), 1)).alias("other_excluded"),
        F.sqrt(stacked.cast("double")).alias("snr"),
        F.coalesce(stacked / F.nullif(total - filtered, F.lit(0)), F.lit(0.0)).alias("success"),
        F.coalesce(F.sum(F.when(F.col("included"), F.col("exposure"))), F.lit(0.0)).alias("exposure"),
    )


def background_uniformity(level: str) -> Column:
    """good, moderate or poor by the coefficient of variation of the frames' backgrounds."""
    spread = F.stddev_pop(level) / F.nullif(F.avg(level), F.lit(0.0))
    return F.when((F.count(level) < 2) | spread.isNull() | (spread < 0.05), "good").when(spread < 0.15, "moderate").otherwise("poor")


#: A background below this does not divide a frame.
LEAST_BACKGROUND = 1e-6


def over_background(pixels: Column, level: Column) -> Column:
    """Samples over the frame's background level, so that frames of other sky brightness can be averaged."""
    return F.when(level > LEAST_BACKGROUND, F.transform(pixels, lambda v: v / level)).otherwise(pixels)


def overlap(bounds: DataFrame, by: str) -> DataFrame:
    """The rectangle that all frames of a group cover: (by, x0, y0, x1, y1), null ends where it is empty."""
    box = bounds.groupBy(by).agg(F.max("x0").alias("x0"), F.max("y0").alias("y0"), F.min("x1").alias("x1"), F.min("y1").alias("y1"))
    whole = (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    return box.select(by, *(F.when(whole, F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")))


def long_form(frames: DataFrame, keep: list[str], width: int, pixels: str = "pixels") -> DataFrame:
    """(keep, x, y, v): one row a pixel."""
    long = frames.select(*keep, F.posexplode(pixels).alias("i", "v"))
    return long.select(*keep, (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), "v")
