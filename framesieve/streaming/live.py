"""Live sessions: running pixel statistics, sessions by a gap, and log lines as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.operators.stacking import pixel_statistics
from framesieve.sources.logs import parse_lines


def live_statistics(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Running count, mean and deviation of every pixel of a stream of frames; the state is three numbers a pixel."""
    return pixel_statistics(pixels, keys)


def live_sessions(frames: DataFrame, by: str, time: str, gap: str = "120 minutes", late: str = "10 minutes") -> DataFrame:
    """(by, start, end, frames): stretches of frames without a pause longer than ``gap``; frames later than ``late`` are dropped."""
    return frames.withWatermark(time, late).groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("frames")).select(by, "w.start", "w.end", "frames")


def live_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed log lines of a folder, new files as they come."""
    return parse_lines(spark.readStream.text(folder).withColumnRenamed("value", "line"))
