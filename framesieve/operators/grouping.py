"""Frames into groups of one orientation and one stretch of time; the group and frames to align to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framesieve.functions.keywords import same_filter
from framesieve.operators.classify import quality_score

#: A turn of the camera that always parts groups (degrees); a pause (minutes) that parts them if it turned by more than a tolerance.
FLIP_DEGREES, GAP_MINUTES, TURN_TOLERANCE = 90.0, 120.0, 10.0


def assign_groups(frames: DataFrame, by: str, observed: str, rotator: str, tie: str, matched: str | None = None) -> DataFrame:
    """frames with ``frame_group``, from 0, within each ``by``.

    Frames are taken by time (unknown times first, ties by ``tie``). A frame opens a group if the camera turned
    by more than FLIP_DEGREES since the one before, or by more than TURN_TOLERANCE after a pause of more than
    GAP_MINUTES. Where either angle is unknown, the turn is that of column ``matched`` (see ``matched_turns``); a turn that stays
    unknown opens a group. An unknown time is no pause.
    """
    order = W.partitionBy(by).orderBy(F.col(observed).asc_nulls_first(), tie)
    turn = F.abs(F.col(rotator) - F.lag(rotator).over(order))
    if matched is not None:
        turn = F.coalesce(turn, F.col(matched))
    pause = F.coalesce((F.col(observed) - F.lag(observed).over(order)) / 60.0, F.lit(0.0))
    split = F.coalesce((turn > FLIP_DEGREES) | ((pause > GAP_MINUTES) & (turn > TURN_TOLERANCE)), F.lit(True))
    first = F.row_number().over(order) == 1
    marked = frames.withColumn("_split", F.when(first, 0).otherwise(split.cast("int")))
    return marked.withColumn("frame_group", F.sum("_split").over(order).cast("long")).drop("_split")


def master_group(grouped: DataFrame, by: str) -> DataFrame:
    """(by, master, frames): the largest group, the last of equal ones."""
    sizes = grouped.groupBy(by, "frame_group").agg(F.count("*").alias("frames"))
    best = F.max(F.struct("frames", "frame_group"))
    return sizes.groupBy(by).agg(best.alias("best")).select(by, F.col("best.frame_group").alias("master"), F.col("best.frames").alias("frames"))


def group_references(frames: DataFrame, by: list[str], order: str, wanted_filter: str | None = None) -> DataFrame:
    """(by, order of the best frame, fallback): the frame of best score with at least half the median star count and
    the wanted filter; of all frames where none has. Ties go to the last frame."""
    group = W.partitionBy(*by)
    n = F.count("star_count").over(group)
    ranked = frames.withColumn("_place", F.row_number().over(group.orderBy(F.col("star_count").asc_nulls_last()))).withColumn("_n", n)
    typical = F.max(F.when(F.col("_place") == F.floor(F.col("_n") / 2) + 1, F.col("star_count"))).over(group)
    fit = F.coalesce(F.col("star_count") >= typical * 0.5, F.lit(False))
    if wanted_filter is not None:
        fit = fit & same_filter(F.col("filter"), F.lit(wanted_filter))
    marked = ranked.withColumn("_fit", fit)
    best = group.orderBy(F.col("_fit").desc(), quality_score().desc(), F.col(order).desc())
    return marked.withColumn("_best", F.row_number().over(best)).where("_best = 1").select(*by, order, (~F.col("_fit")).alias("fallback"))
