"""Paths, file names and labels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image extensions in the order in which they are looked for.
EXTENSIONS = (".xisf", ".fits", ".fts", ".fit")


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def dirof(path: Column) -> Column:
    """What stands before the last slash; a dot without one."""
    return F.when(F.contains(slashed(path), F.lit("/")), F.regexp_extract(slashed(path), r"^(.*)/[^/]*$", 1)).otherwise(".")


def stripext(path: Column) -> Column:
    """Cut after the last image extension (of the first kind that occurs), in any case; unchanged without one."""
    out = path
    for extension in reversed(EXTENSIONS):
        pattern = rf"(?is)^(.*\{extension})"
        out = F.when(F.regexp_like(slashed(path), F.lit(pattern)), F.regexp_extract(slashed(path), pattern, 1)).otherwise(out)
    return out


def frame_label(name: Column) -> Column:
    """The number that ends the part before the last dot (up to 6 digits), else that part's last 8 characters."""
    parts = F.split(name, r"\.")
    stem = F.coalesce(F.get(parts, F.size(parts) - 2), name)
    digits = F.regexp_extract(stem, r"([0-9]*)$", 1)
    return F.when((digits != "") & (F.length(digits) <= 6), digits.try_cast("int").cast("string")).otherwise(F.right(stem, F.lit(8)))


def report_name(first: Column) -> Column:
    """The report's file name from the session's first file: target after ``Light_``, date of the first ``YYYYMMDD-HHMMSS``."""
    name = basename(first)
    target = F.when(F.startswith(name, F.lit("Light_")), F.regexp_extract(name, r"^Light_([^_]*)", 1))
    date = F.nullif(F.regexp_extract(name, r"([0-9]{8})-[0-9]{6}", 1), F.lit(""))
    dated = F.concat(target, F.lit("_"), date, F.lit("_analysis.json"))
    return F.coalesce(dated, F.concat(target, F.lit("_analysis.json")), F.lit("session.json"))


def slug(name: Column) -> Column:
    """Blanks as hyphens; signs other than letters, digits, hyphens and underscores left out."""
    return F.regexp_replace(F.translate(name, " ", "-"), r"[^\p{L}\p{N}_-]", "")
