"""Log files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "TRACE")


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """lines with timestamp, level, module and message.

    ``<time>Z <level> <module>: <message>``: a line without a level is INFO, one without a module has none; a line without a time is
    RAW and all message.
    """
    line = F.col(column)
    timed = F.contains(line, F.lit("Z "))
    stamp = F.regexp_extract(line, r"(?s)^(.*?Z) ", 1)
    rest = F.trim(F.substr(line, F.length(stamp) + 1))
    level = F.regexp_extract(rest, f"^({'|'.join(LEVELS)})", 1)
    tail = F.trim(F.substr(rest, F.length(level) + 1))
    module = F.regexp_extract(tail, r"(?s)^(.*?): ", 1)
    parted = F.contains(tail, F.lit(": "))
    return lines.withColumns(
        {
            "timestamp": F.when(timed, stamp).otherwise(""),
            "level": F.when(~timed, "RAW").when(level == "", "INFO").otherwise(level),
            "module": F.when(timed & parted, module).otherwise(""),
            "message": F.when(~timed, line).when(parted, F.trim(F.substr(tail, F.length(module) + 3))).otherwise(tail),
        }
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, timestamp, level, module, message) of all log files at a path or glob."""
    return parse_lines(spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")))


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, modified, size) of the log files (.log) at a path or glob, the newest first, equal times by name. Only names, times and sizes are read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return files.where(F.col("filename").endswith(".log")).orderBy(F.col("modified").desc(), "filename")
