"""Tables read as the library's entities: frames, images, header maps, paths.

A frame is an order; its metrics come from the order's lines, as exact sums over counts. An image of
8 by 8 pixels is an embedding; a header map is made of an event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, frame_id, background_median, fwhm, eccentricity, star_count): one row per order.

    Session statistics read the metrics several times: persist them, or rows made of them, where that is dear.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("session"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.count("*")
    by_order = lines.groupBy("l_orderkey").agg(
        (F.sum(F.round(F.col("l_discount") * 100).cast("long")) / n / 100).alias("background_median"),
        (F.sum(F.col("l_quantity").cast("long")) / n / 10 + 1).alias("fwhm"),
        (1 - F.min("l_extendedprice") / F.max("l_extendedprice")).alias("eccentricity"),
        F.sum(F.col("l_quantity").cast("long")).cast("int").alias("star_count"),
    )
    return by_order.join(orders, "l_orderkey").select("session", F.col("l_orderkey").alias("frame_id"), "background_median", "fwhm", "eccentricity", "star_count")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, pixels): the embedding as a row-major 8 by 8 image of values around a half."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select("vec_id", "label", F.transform("embedding", lambda e: (e.cast("double") + 1) / 2).alias("pixels"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, i, x, y, v): the images' pixels in long form."""
    long = images(spark, sf_dir).select("vec_id", "label", F.posexplode("pixels").alias("i", "v"))
    return long.select("vec_id", "label", "i", (F.col("i") % SIDE).alias("x"), F.floor(F.col("i") / SIDE).cast("int").alias("y"), "v")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, ts, value, keywords): a header map of name to (value, comment) for each event.

    FILTER is the event's type, ROTATOR its value in whole degrees (missing for every seventh), GAIN the
    number in its properties, with a blank before and after.
    """
    table = spark.read.parquet(f"{sf_dir}/events.parquet")

    def entry(value, comment: str | None):
        return F.struct(value.cast("string").alias("value"), F.lit(comment).cast("string").alias("comment"))

    gain = F.concat(F.lit(" "), F.regexp_extract("props", r"(-?\d+)", 1), F.lit(" "))
    maps = F.map_from_arrays(F.array(F.lit("FILTER"), F.lit("GAIN"), F.lit("ROTATOR")), F.array(entry(F.col("event_type"), "filter name"), entry(gain, None), entry(F.floor("value").cast("long"), "degrees")))
    keywords = F.when(F.col("event_id") % 7 == 0, F.map_filter(maps, lambda k, v: k != "ROTATOR")).otherwise(maps)
    return table.select("event_id", "user_id", "ts", "value", keywords.alias("keywords"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url)."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
