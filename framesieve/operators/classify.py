"""Pass or reject, why, of what kind, and the best frame of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesieve.functions.paths import basename, frame_label
from framesieve.operators.ranges import frame_index
from framesieve.operators.session_stats import deviation, two_pass_stats
from framesieve.operators.tables import small_table

#: Default thresholds: standard deviations for the first three, an absolute value for eccentricity; and their bounds on saving.
THRESHOLDS = {"background_median": 2.5, "fwhm": 2.5, "star_count": 1.5, "eccentricity": 0.85}


def triggers(thresholds: dict[str, float] | None = None) -> Column:
    """Names of the metrics that reject a frame, in their fixed order; a null metric never does. Needs <metric>_mean and _sigma columns."""
    t = THRESHOLDS | (thresholds or {})
    z = {m: deviation(F.col(m), F.col(f"{m}_mean"), F.col(f"{m}_sigma")) for m in ("background_median", "fwhm", "star_count")}
    return F.array_compact(
        F.array(
            F.when(z["background_median"] >= t["background_median"], "BackgroundMedian"),
            F.when(z["fwhm"] >= t["fwhm"], "FWHM"),
            F.when(z["star_count"] <= -t["star_count"], "StarCount"),
            F.when(F.col("eccentricity") >= t["eccentricity"], "Eccentricity"),
        )
    )


def category(triggered: Column) -> Column:
    """O (optics: FWHM, eccentricity or an unknown trigger), B (background), T (transparency), in that order; null without triggers."""
    optics = F.exists(triggered, lambda x: ~x.isin("BackgroundMedian", "StarCount"))
    letters = F.concat(F.when(optics, "O").otherwise(""), F.when(F.array_contains(triggered, "BackgroundMedian"), "B").otherwise(""), F.when(F.array_contains(triggered, "StarCount"), "T").otherwise(""))
    return F.nullif(letters, F.lit(""))


def quality_score(fwhm: str = "fwhm", eccentricity: str = "eccentricity") -> Column:
    """1 / max(fwhm, 0.1) + (1 - eccentricity); a null term counts 0."""
    return F.coalesce(F.when(F.col(fwhm).isNotNull(), 1 / F.greatest(F.col(fwhm), F.lit(0.1))), F.lit(0.0)) + F.coalesce(1 - F.col(eccentricity), F.lit(0.0))


def classify_frames(frames: DataFrame, stats: DataFrame | None = None, thresholds: dict[str, float] | None = None, by: str = "session") -> DataFrame:
    """frames with triggered_by, flag and rejection_category, against their session's two-pass statistics or given ones."""
    joined = frames.join(small_table(stats if stats is not None else two_pass_stats(frames, by)), by)
    marked = joined.withColumn("triggered_by", triggers(thresholds))
    flag = F.when(F.size("triggered_by") > 0, "REJECT").otherwise("PASS")
    return marked.select(*frames.columns, "triggered_by", flag.alias("flag"), category(F.col("triggered_by")).alias("rejection_category"))


def with_reference(classified: DataFrame, by: str = "session", order: str = "frame_id") -> DataFrame:
    """classified with is_reference: the passing frame (any frame if none passes) of best score, then most stars, then last."""
    rank = F.struct((F.col("flag") == "PASS").alias("passes"), quality_score().alias("score"), F.coalesce("star_count", F.lit(0)).alias("stars"), F.col(order).alias("last"))
    best = small_table(classified.groupBy(by).agg(F.max(rank)["last"].alias("_reference")))
    return classified.join(best, by, "left").withColumn("is_reference", F.coalesce(F.col(order) == F.col("_reference"), F.lit(False))).drop("_reference")


def results_view(files: DataFrame, results: DataFrame, key: str, by: str = "session", path: str = "path", imported: str = "imported", thresholds: dict[str, float] | None = None) -> DataFrame:
    """(by, key, path, frame_index, label, short_name, metrics, flag, triggered_by, rejection_category) of all files of the sessions, with results where there are some.

    files: by, key, path, imported; results: by, key, the metrics and, of imported sessions, their flag, triggered_by and rejection_category, which stand. Live sessions are classified anew against
    the statistics of those results whose files are there, by the thresholds that were last used (``thresholds``). frame_index counts a session's files from 0 in the order of their names. A file
    without result has an empty flag and no triggers.

    The results of the files that are there, a few numbers a frame, are persisted for the passes over their session's statistics.
    """
    metrics = ["background_median", "fwhm", "eccentricity", "star_count"]
    verdicts = ["flag", "triggered_by", "rejection_category"]
    listed = results.select(by, key, *metrics, *verdicts).join(files.select(by, key, imported), [by, key]).persist()
    live = classify_frames(listed.where(~F.col(imported)).select(by, key, *metrics), thresholds=thresholds, by=by)
    given = listed.where(imported).select(by, key, *metrics, *verdicts)
    indexed = frame_index(files, by, path, key)
    joined = indexed.join(live.unionByName(given), [by, key], "left")
    short = basename(F.col(path))
    shown = {"flag": F.coalesce("flag", F.lit("")), "triggered_by": F.coalesce("triggered_by", F.array().cast("array<string>"))}
    return joined.withColumns(shown | {"short_name": short, "label": frame_label(short)}).select(by, key, path, "frame_index", "label", "short_name", *metrics, *verdicts)
