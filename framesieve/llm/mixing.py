"""Mixing sources to target weights (operator 10): hash-threshold histograms.

Sizes are summed by source and hash bucket; a source's budget then lies in one bucket, which alone
is summed again by finer buckets, and the documents of the one finer bucket in which the budget ends
are looked at by hash. The outcome is a hash threshold per source, so documents are filtered, never sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framesieve.llm.common import durable, quoted, small_batches, unused

#: Weights of sources in code point order (null last), repeating; share of all sizes to take; copies of a document at most.
WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2
#: Hashes have HASH_BITS bits; a histogram tells BUCKET_BITS of them apart.
HASH_BITS, BUCKET_BITS = 60, 12
#: A table of one row per source is broadcast up to so many rows; beyond, Spark joins it as it sees fit.
BROADCAST_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def document_hash(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """60 bits of the MD5 of the id as text, a blank, and the MD5 of the text (null id or text: the empty text)."""
    digest = F.md5(F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _placed(sources: DataFrame) -> DataFrame:
    """sources with ``place``, from 0 in code point order, null last: rows are sorted by range, and each range counts on from those before it."""
    ordered = durable(sources.orderBy(F.col("source").asc_nulls_last())).withColumn("_n", F.monotonically_increasing_id())
    ordered = ordered.withColumns({"_range": F.shiftright("_n", 33), "_row": F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))})
    before, so_far = {}, 0
    for r in sorted(ordered.groupBy("_range").count().collect()):  # a row for each partition
        before[r["_range"]], so_far = so_far, so_far + r["count"]
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)), F.col("_range")) if before else F.lit(0)
    return ordered.withColumn("place", offset + F.col("_row")).drop("_n", "_range", "_row")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): the budget shared by weight, no source above ``most`` times its size.

    Targets are weight times a level, or the cap. The level starts as if no source were capped; those below are then held to
    their caps and the rest shared anew, until no other source is capped. That takes a few sums over all sources, each aggregated where the rows are.
    """
    weight = F.element_at(F.array([F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = _placed(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = durable(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    left = (ranked.agg(F.sum("source_size")).first()[0] or 0) * float(budget)
    level, capped = 0.0, -1
    while True:
        held = F.col("cap") < F.lit(level) * F.col("weight")
        row = ranked.agg(F.count(F.when(held, 1)), F.coalesce(F.sum(F.when(held, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0))).first()
        if row[0] == capped:
            break
        capped = row[0]
        level = (left - row[1]) / row[2] if row[2] else math.inf  # infinite: every source is held to its cap
        if not row[2]:
            break
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def _per_source(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _boundary(histogram: DataFrame, bucket: str, width: int) -> DataFrame:
    """For each source the bucket in which its quota ends: (source, quota, before: size below it, low: its first hash).

    No row if the quota covers all buckets. histogram: source, quota, before, low, bucket, size.
    """
    so_far = F.sum("size").over(W.partitionBy("source").orderBy(bucket)) - F.col("size") + F.col("before")
    found = histogram.withColumn("before", so_far).where((F.col("before") <= F.col("quota")) & (F.col("quota") < F.col("before") + F.col("size")))
    return found.select("source", "quota", "before", (F.col("low") + F.col(bucket) * F.lit(width)).alias("low"))


def source_thresholds(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """One row per source: source_size, target, ``copies`` every document gets, ``threshold``: hashes up to it get one more.

    sized: source, size, hash. A source's quota (its target less the copies all get) is met by the
    documents of smallest hash; a document is in if at least half of it still fits.
    """
    first, second = 1 << (HASH_BITS - BUCKET_BITS), 1 << (HASH_BITS - 2 * BUCKET_BITS)
    histogram = durable(sized.groupBy("source", F.shiftright("hash", HASH_BITS - BUCKET_BITS).alias("bucket")).agg(F.sum("size").alias("size")))
    targets = source_targets(histogram, weights, budget, most)
    copies = F.when((F.col("source_size") > 0), F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most) - 1))).otherwise(0).cast("long")
    plan = durable(targets.withColumn("copies", copies).withColumn("quota", F.col("target") - F.col("copies") * F.col("source_size")))
    quotas = plan.select(F.col("source").alias("s"), "quota")

    def of_source(df: DataFrame, table: DataFrame) -> DataFrame:
        return df.join(_per_source(table), df["source"].eqNullSafe(table["s"])).drop("s")

    coarse = _boundary(of_source(histogram, quotas).withColumns({"before": F.lit(0).cast("long"), "low": F.lit(0).cast("long")}), "bucket", first)
    coarse = durable(coarse.withColumnRenamed("source", "s"))
    inside = of_source(sized.select("source", "size", "hash"), coarse).where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + F.lit(first)))
    finer = inside.groupBy("source", "quota", "before", "low", F.shiftright(F.col("hash") - F.col("low"), HASH_BITS - 2 * BUCKET_BITS).alias("bucket")).agg(F.sum("size").alias("size"))
    fine = durable(_boundary(finer, "bucket", second).withColumnRenamed("source", "s"))
    last = of_source(sized.select("source", "size", "hash"), fine).where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + F.lit(second)))
    by_hash = last.groupBy("source", "quota", "before", "low", "hash").agg(F.sum("size").alias("size"))
    middle = F.sum("size").over(W.partitionBy("source").orderBy("hash")) - F.col("size") / 2 + F.col("before")
    ends = by_hash.withColumn("fits", middle <= F.col("quota")).groupBy(F.col("source").alias("s")).agg(F.max(F.when(F.col("fits"), F.col("hash")).otherwise(F.col("low") - 1)).alias("end"))
    joined = plan.join(ends, plan["source"].eqNullSafe(ends["s"]), "left")
    return durable(joined.select("source", "source_size", "target", "copies", F.coalesce("end", F.lit((1 << HASH_BITS) - 1)).alias("threshold")))


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, hash): size counts the words of the whole text, 0 for null."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), document_hash(id_col, text_col).alias("hash"))


def mix_plan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and ``times`` it is taken (0, 1 or 2).

    A null text has size 0; null is a source of its own; rows equal in id and text share a hash and so are taken
    alike, others of an id are not; an empty table gives no row. A source of size 0 has target 0.
    """
    sized = durable(sized_documents(docs))
    ends = source_thresholds(sized).withColumnRenamed("source", "s")
    joined = sized.join(_per_source(ends), sized["source"].eqNullSafe(ends["s"]))
    times = F.col("copies") + (F.col("hash") <= F.col("threshold")).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", times.alias("times"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row for each time a document is taken, with the columns of ``docs``, whatever their names.

    Null texts, null sources, repeated rows and empty tables as in ``mix_plan``; a document of no words is taken as others of its hash are.
    """
    source, copies, end, time = unused(["mix_source", "mix_copies", "mix_end", "mix_time"], docs.columns)
    ends = source_thresholds(durable(sized_documents(docs))).select(F.col("source").alias(source), F.col("copies").alias(copies), F.col("threshold").alias(end))
    joined = docs.join(_per_source(ends), docs["source"].eqNullSafe(ends[source]))
    times = F.col(copies) + (document_hash() <= F.col(end)).cast("long")
    return joined.withColumn(time, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*map(quoted, docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


#: The same by sorting every source's documents, for DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), r AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, [3.0, 1.0, 2.0][place % 3 + 1]::DOUBLE AS weight FROM s
), l AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, (ratio, place)) FROM l WHERE level <= ratio) * weight, cap)) AS target FROM l
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 1) ELSE 0 END::BIGINT AS copies FROM t
), c AS (
  SELECT d.*, q.source_size, q.target, q.copies, q.target - q.copies * q.source_size AS quota,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far,
    sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, (size * (copies + (so_far - own / 2 <= quota)::BIGINT))::BIGINT AS taken FROM c
"""
