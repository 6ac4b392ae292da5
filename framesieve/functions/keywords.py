"""Header maps: map<string, struct<value, comment>>, names in capitals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest name of a header keyword.
NAME_LENGTH = 8


def value(keywords: Column, name: str, default: str | None = None) -> Column:
    """The trimmed value, or the default."""
    found = F.trim(F.try_element_at(keywords, F.lit(name.upper()))["value"])
    return found if default is None else F.coalesce(found, F.lit(default))


def number(keywords: Column, name: str) -> Column:
    """The value as a double, null if there is none or it is no number."""
    return value(keywords, name).try_cast("double")


def matches(keywords: Column, name: str, wanted: str) -> Column:
    """Whether the value equals ``wanted`` but for case and outer blanks; a missing keyword does not."""
    return F.coalesce(F.lower(value(keywords, name)) == wanted.strip().lower(), F.lit(False))


def _entry(content: Column, comment: Column) -> Column:
    return F.struct(content.cast("string").alias("value"), comment.cast("string").alias("comment"))


def _put(keywords: Column, name: str, entry: Column) -> Column:
    return F.map_concat(F.map_filter(keywords, lambda k, _: k != name), F.map_from_arrays(F.array(F.lit(name)), F.array(entry)))


def added(keywords: Column, name: str, content: Column, comment: str | None = None) -> Column:
    """With the keyword set, whether it was there or not."""
    name = name.upper()
    if len(name) > NAME_LENGTH:
        raise ValueError(f"a keyword has at most {NAME_LENGTH} letters: {name}")
    return _put(keywords, name, _entry(content, F.lit(comment)))


def deleted(keywords: Column, name: str) -> Column:
    """Without the keyword, if it was there."""
    return F.map_filter(keywords, lambda k, _: k != name.upper())


def modified(keywords: Column, name: str, content: Column, comment: str | None = None) -> Column:
    """With a new value where the keyword is; its comment stays unless one is given."""
    name = name.upper()
    old = F.try_element_at(keywords, F.lit(name))["comment"]
    return F.when(F.map_contains_key(keywords, name), _put(keywords, name, _entry(content, old if comment is None else F.lit(comment)))).otherwise(keywords)


def copied(keywords: Column, source: str, target: str) -> Column:
    """With value and comment of ``source`` under ``target`` too, where source is."""
    source, target = source.upper(), target.upper()
    return F.when(F.map_contains_key(keywords, source), _put(keywords, target, F.try_element_at(keywords, F.lit(source)))).otherwise(keywords)


def listed(keywords: Column) -> Column:
    """array of struct(name, value, comment, line), by name; line is ``NAME       = value  / comment``."""

    def row(e: Column) -> Column:
        tail = F.when(e["value"]["comment"].isNull() | (e["value"]["comment"] == ""), "").otherwise(F.concat(F.lit("  / "), e["value"]["comment"]))
        return F.struct(e["key"].alias("name"), e["value"]["value"].alias("value"), e["value"]["comment"].alias("comment"), F.concat(F.rpad(e["key"], 10, " "), F.lit(" = "), e["value"]["value"], tail).alias("line"))

    return F.array_sort(F.transform(F.map_entries(keywords), row))


def same_filter(a: Column, b: Column) -> Column:
    """Filters match unless both are known and differ (but for case and outer blanks)."""
    return a.isNull() | b.isNull() | (F.upper(F.trim(a)) == F.upper(F.trim(b)))


def observed_at(text: Column) -> Column:
    """Epoch seconds of a date with or without a fraction (which is dropped); null if it is no date."""
    return F.unix_timestamp(F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss"))))
