"""Set operations on tables of frames, settings and versions, each as one join or window."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framesieve.functions.paths import dirof, slug


#: Rows up to which a table of statistics is taken into the plan as it is and broadcast; a larger one is joined by a shuffle.
SMALL = 10_000


def small_table(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df``, computed once and marked for broadcasting, if it has ``most`` rows or less; else as it is."""
    rows = df.limit(most + 1).collect()
    return df if len(rows) > most else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def materialised(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the session's spark.checkpoint.dir from now on, which outlives executors. Only a local master may leave it unset."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return df.checkpoint()


def not_loaded(candidates: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Candidates whose key is not among the loaded ones."""
    return candidates.join(loaded.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, one for each key (the greatest by its other columns), and those of ``old`` whose key it lacks."""
    others = [c for c in new.columns if c != key]
    once = new.groupBy(key).agg(F.max(F.struct(*others)).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in others))
    return old.join(new.select(key), key, "left_anti").unionByName(once)


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old``, and those of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def newest(rows: DataFrame, by: str, time: str, tie: str, count: int) -> DataFrame:
    """The ``count`` newest rows of each group."""
    order = W.partitionBy(by).orderBy(F.col(time).desc(), F.col(tie).desc())
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= count).drop("_place")


def latest(rows: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """(by, value of the newest row, versions)."""
    return rows.groupBy(*by).agg(F.max(F.struct(time, value)).alias("_last"), F.count("*").alias("versions")).select(*by, F.col(f"_last.{value}").alias(value), "versions")


def restored(current: DataFrame, versions: DataFrame, chosen: DataFrame, key: str, value: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(current, versions) once the ``chosen`` versions (key, saved_at; one a key) are current again.

    current: key, value, updated_at; versions: key, value, saved_at. What was current is kept as a version saved ``at`` that time, and ``updated_at`` is that time. A chosen version
    that is not there changes nothing.
    """
    found = versions.join(chosen.select(key, "saved_at"), [key, "saved_at"]).groupBy(key).agg(F.max(value).alias("_old"))
    met = current.join(found, key, "left")
    back = F.col("_old").isNotNull()
    kept = met.where(back).select(key, value, at.alias("saved_at"))
    now = met.withColumns({value: F.coalesce("_old", value), "updated_at": F.when(back, at).otherwise(F.col("updated_at"))}).select(*current.columns)
    return now, versions.select(key, value, "saved_at").unionByName(kept)


def counted(rows: DataFrame, runs: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with their ``count`` raised by the number of their ``runs`` (one row a run); a null count is 0."""
    done = runs.groupBy(key).agg(F.count("*").alias("_runs"))
    return rows.join(done, key, "left").withColumn(count, F.coalesce(F.col(count), F.lit(0)) + F.coalesce("_runs", F.lit(0))).select(*rows.columns)


def renamed(rows: DataFrame, given: DataFrame, key: str, name: str = "name", display: str = "display_name") -> DataFrame:
    """``rows`` with the display names of ``given`` (key, display; one a key) and the names derived from them, and ``error``: set, and the row as it was, where a name would be empty."""
    met = rows.join(given.select(key, F.col(display).alias("_new")), key, "left")
    derived = slug(F.col("_new"))
    good = F.coalesce(derived != "", F.lit(False))
    changed = {name: F.when(good, derived).otherwise(F.col(name)), display: F.when(good, F.col("_new")).otherwise(F.col(display))}
    return met.withColumn("error", F.when(F.col("_new").isNotNull() & ~good, "the display name gives an empty name")).withColumns(changed).select(*rows.columns, "error")


def overridden(results: DataFrame, by_hand: DataFrame, key: str, column: str) -> DataFrame:
    """``results`` with the values of ``column`` that ``by_hand`` (key, column; one row a key) gives instead of their own."""
    given = by_hand.select(key, F.col(column).alias("_by_hand"))
    return results.join(given, key, "left").withColumn(column, F.coalesce("_by_hand", column)).select(*results.columns)


def count_files(files: DataFrame, by: str) -> DataFrame:
    """(by, files)."""
    return files.groupBy(by).agg(F.count("*").alias("files"))


def common_directory(files: DataFrame, by: str, path: str) -> DataFrame:
    """(by, directories, common): how many folders a session's files are in, and the folder if it is one."""
    folders = files.groupBy(by, dirof(F.col(path)).alias("_dir")).agg(F.count("*"))
    return folders.groupBy(by).agg(F.count("*").alias("directories"), F.when(F.count("*") == 1, F.max("_dir")).alias("common"))


def find_by_name(rows: DataFrame, column: str, name: str | Column) -> DataFrame:
    """Rows of that name, capitals or not."""
    wanted = F.lit(name) if isinstance(name, str) else name
    return rows.where(F.lower(column) == F.lower(wanted))


def join_by_name(left: DataFrame, left_name: str, right: DataFrame, right_name: str) -> DataFrame:
    """Pairs of rows whose names are equal, capitals or not: a join on the lowered names. ``left`` and ``right`` share no column names."""
    a, b = left.withColumn("_name", F.lower(left_name)), right.withColumn("_name", F.lower(right_name))
    return a.join(b, "_name").drop("_name")


def by_name(rows: DataFrame, column: str) -> DataFrame:
    """Rows in the order of their names, capitals or not; equal ones in code point order."""
    return rows.orderBy(F.lower(column), column)


def placed(ordered: DataFrame, name: str) -> DataFrame:
    """``ordered`` (sorted by range) with each row's place, from 1: a range counts on from those before it; one number for each range comes to the driver."""
    kept = ordered.persist()
    numbered = kept.withColumn("_n", F.monotonically_increasing_id())
    numbered = numbered.withColumns({"_range": F.shiftright("_n", 33), "_row": F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))})
    before, so_far = {}, 1
    for r in sorted(numbered.groupBy("_range").count().collect()):
        before[r["_range"]], so_far = so_far, so_far + r["count"]
    if not before:
        return kept.withColumn(name, F.lit(0).cast("long"))
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)), F.col("_range"))
    return numbered.withColumn(name, offset + F.col("_row")).drop("_n", "_range", "_row")


def read_outcomes(loaded: DataFrame, unreadable: DataFrame, missing: DataFrame, key: str) -> DataFrame:
    """(key, outcome) of all frames that were asked for."""
    parts = [df.select(key, F.lit(name).alias("outcome")) for df, name in ((loaded, "loaded"), (unreadable, "unreadable"), (missing, "missing"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def clamped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
