"""Session reports: thresholds, statistics and frames as JSON, out and in; result tables as tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesieve.operators.classify import THRESHOLDS
from framesieve.operators.session_stats import METRICS
from framesieve.operators.tables import small_table

FRAME_SCHEMA = "filename string, fwhm double, eccentricity double, star_count int, background_median double, flag string, is_reference boolean, triggered_by array<string>, rejection_category string"
_STATS = ", ".join(f"{m}: struct<mean: double, stddev: double>" for m in METRICS)
_THRESHOLDS = "thresholds struct<background_median: double, fwhm: double, star_count: double, eccentricity: double>"
REPORT_SCHEMA = f"{_THRESHOLDS}, session_stats struct<{_STATS}>, outliers array<string>, frames array<struct<{', '.join(c.replace(' ', ': ', 1) for c in FRAME_SCHEMA.split(', '))}>>"
LINE_SCHEMA = f"{_THRESHOLDS}, session_stats struct<{_STATS}>, frame struct<{', '.join(c.replace(' ', ': ', 1) for c in FRAME_SCHEMA.split(', '))}>, outlier boolean"


def _frame(classified: DataFrame) -> tuple[DataFrame, list[str]]:
    names = [c.split(" ")[0] for c in FRAME_SCHEMA.split(", ")]
    named = classified.withColumn("filename", F.col("frame_id").cast("string"))
    return (named if "is_reference" in named.columns else named.withColumn("is_reference", F.lit(False))), names


def _given(thresholds: dict[str, float] | None):
    return F.struct(*(F.lit(v).alias(k) for k, v in (THRESHOLDS | (thresholds or {})).items()))


def _stats():
    return F.struct(*(F.struct(F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_sigma").alias("stddev")).alias(m) for m in METRICS))


def export_sessions(classified: DataFrame, by: list[str], thresholds: dict[str, float] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(by, report): one JSON document for each group, its frames by name, the names of outliers (column ``outlier``, if there) and, if given, its statistics.

    A document is one row: give groups of bounded size. ``report_lines`` has no such limit.
    """
    named, names = _frame(classified)
    frames = F.array_sort(F.collect_list(F.struct(*names)))
    far = F.array_sort(F.collect_list(F.when(F.col("outlier"), F.col("filename")))) if "outlier" in classified.columns else F.array().cast("array<string>")
    groups = named.groupBy(*by).agg(frames.alias("frames"), far.alias("outliers"))
    if stats is not None:
        groups = groups.join(small_table(stats), by).withColumn("session_stats", _stats())
    fields = [_given(thresholds).alias("thresholds"), *(["session_stats"] if stats is not None else []), "outliers", "frames"]
    return groups.select(*by, F.to_json(F.struct(*fields)).alias("report"))


def report_lines(classified: DataFrame, stats: DataFrame, by: str = "session", thresholds: dict[str, float] | None = None) -> DataFrame:
    """(by, line): the report as JSON lines: one with thresholds and statistics for each session, one for each frame. Nothing is gathered, so sessions may be of any size."""
    named, names = _frame(classified)
    outlier = F.col("outlier") if "outlier" in classified.columns else F.lit(False)
    heads = stats.select(by, F.to_json(F.struct(_given(thresholds).alias("thresholds"), _stats().alias("session_stats"))).alias("line"))
    return heads.unionByName(named.select(by, F.to_json(F.struct(F.struct(*names).alias("frame"), outlier.alias("outlier"))).alias("line")))


def _checked(frames: DataFrame) -> DataFrame:
    flag = F.when(F.col("flag") == "REJECT", "REJECT").otherwise("PASS")
    return frames.withColumns({"flag": flag, "triggered_by": F.coalesce("triggered_by", F.array().cast("array<string>")), "is_reference": F.coalesce("is_reference", F.lit(False))})


def import_frames(reports: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """The frames of JSON reports, one row each, with ``outlier`` and ``imported``; every flag but REJECT is PASS, missing triggers are none."""
    parsed = reports.select(*keep, F.from_json(column, REPORT_SCHEMA).alias("r")).select(*keep, F.coalesce("r.outliers", F.array().cast("array<string>")).alias("_far"), F.explode("r.frames").alias("f"))
    return _checked(parsed.select(*keep, "f.*", F.array_contains("_far", F.col("f.filename")).alias("outlier"), F.lit(True).alias("imported")))


def import_lines(lines: DataFrame, keep: list[str], column: str = "line") -> DataFrame:
    """The frames of reports as ``report_lines`` writes them, as in ``import_frames``."""
    parsed = lines.select(*keep, F.from_json(column, LINE_SCHEMA).alias("r")).where("r.frame IS NOT NULL")
    return _checked(parsed.select(*keep, "r.frame.*", F.coalesce("r.outlier", F.lit(False)).alias("outlier"), F.lit(True).alias("imported")))


def imported_statistics(reports: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(keep, metric, mean, stddev) of the reports or lines that hold statistics."""
    parsed = reports.select(*keep, F.from_json(column, LINE_SCHEMA)["session_stats"].alias("s")).where("s IS NOT NULL")
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"s.{m}.mean").alias("mean"), F.col(f"s.{m}.stddev").alias("stddev")) for m in METRICS))
    return parsed.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def imported_thresholds(reports: DataFrame, column: str) -> DataFrame:
    """Thresholds of the reports; the star count's without its sign."""
    t = reports.select(F.from_json(column, REPORT_SCHEMA)["thresholds"].alias("t")).select("t.*")
    return t.withColumn("star_count", F.abs("star_count"))


def write_tsv(results: DataFrame, folder: str) -> None:
    """A results table as tab-separated text with a header line, every field in quotes, quotes doubled; one file a partition."""
    results.write.csv(folder, sep="\t", header=True, quoteAll=True, escape='"', nullValue="", emptyValue="")
