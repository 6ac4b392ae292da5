"""Pixel sizes of cameras and the plate scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.functions.keywords import number, value

#: Parts of camera names with the pixel size in micrometres; the first part that a name holds counts.
PIXEL_SIZES = (
    ("533mc", 3.76),
    ("2600mc", 3.76),
    ("2600mm", 3.76),
    ("1600mc", 3.80),
    ("1600mm", 3.80),
    ("294mc", 4.63),
    ("183mc", 2.40),
    ("183mm", 2.40),
    ("071mc", 4.78),
    ("6200mc", 3.76),
    ("6200mm", 3.76),
    ("2400mc", 5.94),
    ("268mc", 3.76),
    ("585mc", 2.90),
    ("imx571", 3.76),
    ("imx294", 4.63),
    ("imx183", 2.40),
    ("imx455", 3.76),
)
#: Arc seconds per radian over a thousand.
ARC = 206.265


def camera_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(PIXEL_SIZES)], "ord int, pattern string, size_um double")


def pixel_size(instrument: Column) -> Column:
    """Micrometres for the first known part of the name, in any case; null if there is none."""
    name = F.lower(instrument)
    return F.coalesce(*(F.when(F.contains(name, F.lit(part)), F.lit(size)) for part, size in PIXEL_SIZES))


def plate_scale_of(keywords: Column) -> Column:
    """Arc seconds per pixel from a header: FOCALLEN, XBINNING and the camera's name in INSTRUME."""
    return plate_scale(number(keywords, "FOCALLEN"), pixel_size(value(keywords, "INSTRUME")), number(keywords, "XBINNING"))


def plate_scale(focal_mm: Column, pixel_um: Column, binning: Column) -> Column:
    """Arc seconds per pixel; binning 1 if missing, null if a length is missing or the focal length not above 0."""
    return F.when(focal_mm > 0, pixel_um * F.coalesce(binning, F.lit(1.0)) / focal_mm * ARC)
