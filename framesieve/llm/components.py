"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesieve.llm.common import durable


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))


def component_labels(links: DataFrame) -> DataFrame:
    """(node, label): every node of ``links`` (columns a, b; long) with the least node of its component.

    A link with a null end and a link of a node with itself are left out. Each step keeps at most as
    many links as there were; least neighbours are aggregated before the shuffle, so a node with very
    many links costs one row for each task. The small step comes first: where many links lead from a
    node to several smaller ones it leaves one of them, and links among those. The links of every step lie in the checkpoint folder.
    """
    both = links.where("a <> b")
    now = durable(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        least = _least(now)
        others = now.join(least, now["u"] == least["k"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = durable(others.union(least).distinct())
        either = small.union(small.select("v", "u"))
        least = _least(either)
        far = either.join(least, either["u"] == least["k"]).where("v > u").select(F.col("v").alias("u"), F.least("k", "m").alias("v"))
        now = durable(far.distinct())
        children = now.groupBy("u").agg(F.count("*").alias("n"))
        inner = children.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        if inner == 0 and children.where("n > 1").limit(1).count() == 0:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
