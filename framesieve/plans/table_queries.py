"""Queries that join, order and merge tables of frames, and read and write reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.operators import classify as C
from framesieve.operators import ranges as RG
from framesieve.operators import session_stats as S
from framesieve.operators import tables as TB
from framesieve.plans import sql
from framesieve.plans.session_queries import rounded
from framesieve.sources.adapters import frames
from framesieve.sources.reports import import_lines, imported_statistics, report_lines

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


@query(f"WITH {sql.CLASSIFIED} SELECT o_orderkey AS frame_id, flag, rejection_category FROM orders JOIN classified ON frame_id = o_orderkey")
def q_export_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the session that have results."""
    results = C.classify_frames(frames(spark, sf_dir).persist()).select("frame_id", "flag", "rejection_category")
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("frame_id")).join(results, "frame_id")


@query(
    f"""WITH {sql.CLASSIFIED}, files AS (SELECT o_orderpriority AS session, o_orderkey AS frame_id, o_orderpriority < '3' AS imported, strftime(o_orderdate, '%Y-%m-%d') || '_' || lpad(o_orderkey::VARCHAR, 6, '0') || '.fit' AS short_name FROM orders)
SELECT f.session, f.frame_id, row_number() OVER (PARTITION BY f.session ORDER BY short_name, f.frame_id) - 1 AS frame_index, short_name, (lpad(f.frame_id::VARCHAR, 6, '0'))::INT::VARCHAR AS label,
  CASE WHEN c.frame_id IS NULL THEN '' WHEN NOT imported THEN flag WHEN f.frame_id % 5 = 0 THEN 'REJECT' ELSE 'PASS' END AS flag,
  CASE WHEN c.frame_id IS NULL THEN '' WHEN NOT imported THEN triggered_by WHEN f.frame_id % 5 = 0 THEN 'FWHM,Clouds' ELSE '' END AS triggered_by,
  CASE WHEN NOT imported THEN rejection_category WHEN c.frame_id IS NOT NULL AND f.frame_id % 5 = 0 THEN 'O' END AS rejection_category FROM files f LEFT JOIN classified c ON c.frame_id = f.frame_id"""
)
def q_results_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of all sessions with their place and label; live sessions are classified anew, the verdicts of imported ones stand."""
    key, imported = F.col("frame_id"), F.col("session") < "3"
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit(".fit"))
    files = _orders(spark, sf_dir).select(F.col("o_orderpriority").alias("session"), F.col("o_orderkey").alias("frame_id"), F.concat(F.lit("/data/"), name).alias("path")).withColumn("imported", imported)
    out = imported & (key % 5 == 0)
    verdicts = {"flag": F.when(out, "REJECT").otherwise("PASS"), "triggered_by": F.when(out, F.array(F.lit("FWHM"), F.lit("Clouds"))).otherwise(F.array().cast("array<string>")), "rejection_category": F.when(out, "O")}
    view = C.results_view(files, frames(spark, sf_dir).withColumns(verdicts), "frame_id")
    return view.select("session", "frame_id", "frame_index", "short_name", "label", "flag", F.array_join("triggered_by", ",").alias("triggered_by"), "rejection_category")


@query("SELECT o_orderkey AS frame_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def q_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are not loaded yet."""
    loaded = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 45").select(F.col("l_orderkey").alias("frame_id"))
    return TB.not_loaded(_orders(spark, sf_dir).select(F.col("o_orderkey").alias("frame_id")), loaded, "frame_id")


@query("SELECT o_orderkey AS frame_id, CASE o_orderstatus WHEN 'F' THEN 'loaded' WHEN 'P' THEN 'unreadable' ELSE 'missing' END AS outcome FROM orders")
def q_read_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames read, frames that could not be read and missing ones, in one table."""
    orders = _orders(spark, sf_dir).withColumnRenamed("o_orderkey", "frame_id")
    return TB.read_outcomes(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), orders.where("o_orderstatus NOT IN ('F', 'P')"), "frame_id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT -n_nationkey - 1, n_name FROM nation")
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings: new values win, new keys are added, the rest stays."""
    old = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    added = spark.read.parquet(f"{sf_dir}/nation.parquet").select((-F.col("n_nationkey") - 1).cast("long").alias("id"), F.col("n_name").alias("value"))
    return TB.upsert(old, old.where("id % 3 = 0").withColumn("value", F.lit("changed")).unionByName(added), "id")


@query("SELECT c_custkey AS id, c_mktsegment AS value FROM customer UNION ALL SELECT -n_nationkey - 1, n_name FROM nation")
def q_seed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults are inserted only where there is no value."""
    old = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    added = spark.read.parquet(f"{sf_dir}/nation.parquet").select((-F.col("n_nationkey") - 1).cast("long").alias("id"), F.col("n_name").alias("value"))
    return TB.insert_missing(old, old.where("id % 3 = 0").withColumn("value", F.lit("default")).unionByName(added), "id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def q_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest entries of each list stay."""
    return TB.newest(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "event_id", 10).select("user_id", "event_id")


@query("SELECT user_id, event_type AS name, arg_max(event_id, (ts, event_id)) AS version, count(*) AS versions FROM events GROUP BY 1, 2")
def q_latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of each macro that was saved last."""
    return TB.latest(spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "name"), ["user_id", "name"], "ts", "event_id").withColumnRenamed("event_id", "version")


@query(
    """WITH v AS (SELECT user_id, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS m, max(event_id) OVER (PARTITION BY user_id) AS last FROM events)
SELECT user_id, event_id AS saved_at, props AS script, false AS is_current FROM v WHERE n < m UNION ALL SELECT user_id, last + 1, max(props) FILTER (n = CASE WHEN m >= 3 THEN 2 ELSE m END), true FROM v GROUP BY user_id, last, m HAVING m >= 3
UNION ALL SELECT user_id, last, max(props) FILTER (n = m), true FROM v GROUP BY user_id, last, m HAVING m < 3 UNION ALL SELECT user_id, last + 1, max(props) FILTER (n = m), false FROM v GROUP BY user_id, last, m HAVING m >= 3"""
)
def q_restored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros (the last of each user's events) and their versions once the second version of each is restored; macros with one version or none stay."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("saved_at"), F.col("props").alias("script"))
    last = events.groupBy("user_id").agg(F.max_by("script", "saved_at").alias("script"), F.max("saved_at").alias("updated_at"))
    versions = events.join(last.select("user_id", "updated_at"), "user_id").where("saved_at < updated_at").drop("updated_at")
    chosen = RG.ranked(versions.select("user_id", "saved_at"), "user_id", [F.col("saved_at").asc()], "n").where("n = 2")
    now, kept = TB.restored(last, versions, chosen, "user_id", "script", F.col("updated_at") + 1)
    return kept.withColumn("is_current", F.lit(False)).unionByName(now.select("user_id", "script", F.col("updated_at").alias("saved_at"), F.lit(True).alias("is_current")))


@query("SELECT c_custkey, (c_nationkey + (SELECT count(*) FROM orders WHERE o_custkey = c_custkey))::BIGINT AS run_count FROM customer")
def q_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run counters raised by the runs of each macro."""
    macros = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").cast("long").alias("run_count"))
    return TB.counted(macros, _orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "run_count")


@query(
    r"""WITH g AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' no. ' || p_size WHEN p_partkey % 3 = 1 THEN '?!' END AS d FROM part), s AS (
  SELECT *, regexp_replace(replace(d, ' ', '-'), '[^\p{L}\p{N}_-]', '', 'g') AS n FROM g)
SELECT p_partkey, CASE WHEN n <> '' THEN n ELSE 'part' END AS name, CASE WHEN n <> '' THEN d ELSE p_name END AS display_name, CASE WHEN n = '' THEN 'the display name gives an empty name' END AS error FROM s"""
)
def q_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros under new display names; a third keep theirs, a third are given one without a letter."""
    part, key = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    given = part.where(key % 3 < 2).select("p_partkey", F.when(key % 3 == 0, F.concat("p_name", F.lit(" no. "), F.col("p_size").cast("string"))).otherwise("?!").alias("display_name"))
    return TB.renamed(part.select("p_partkey", F.lit("part").alias("name"), F.col("p_name").alias("display_name")), given, "p_partkey")


@query("SELECT o_orderkey AS frame_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate::DATE::VARCHAR || '.fit', o_orderkey) - 1 AS frame_index FROM orders")
def q_frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a session in the order of their file names; equal names keep the order in which they were loaded."""
    orders = _orders(spark, sf_dir).select("o_orderpriority", F.col("o_orderkey").alias("frame_id"), F.concat(F.lit("/data/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".fit")).alias("path"))
    return RG.frame_index(orders, "o_orderpriority", "path", "frame_id").select("frame_id", F.col("frame_index").cast("long"))


@query("SELECT o_orderkey AS frame_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate::DATE::VARCHAR || '.fit', o_orderkey) = 8")
def q_set_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame at index 7 of each session."""
    orders = _orders(spark, sf_dir).select("o_orderpriority", F.col("o_orderkey").alias("frame_id"), F.concat(F.lit("/data/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".fit")).alias("path"))
    return RG.frame_index(orders, "o_orderpriority", "path", "frame_id").where("frame_index = 7").select("frame_id")


@query("SELECT o_orderpriority AS session, count(*) AS files FROM orders GROUP BY 1")
def q_count_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.count_files(_orders(spark, sf_dir).withColumnRenamed("o_orderpriority", "session"), "session")


@query("SELECT c_custkey, round(greatest(0.5, least(5, c_acctbal / 1000)), 6) AS fwhm_sigma, round(greatest(0, least(1, c_acctbal / 10000)), 6) AS eccentricity FROM customer")
def q_threshold_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds are held to their bounds on saving."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rounded(c.select("c_custkey", TB.clamped(F.col("c_acctbal") / 1000, 0.5, 5.0).alias("fwhm_sigma"), TB.clamped(F.col("c_acctbal") / 10000, 0.0, 1.0).alias("eccentricity")))


@query(
    f"""WITH {sql.CLASSIFIED} SELECT c.session, c.frame_id, flag, triggered_by, rejection_category, c.star_count, outlier,
row_number() OVER (PARTITION BY c.session ORDER BY (flag = 'PASS') DESC, score DESC, c.star_count DESC, c.frame_id DESC) = 1 AS is_reference FROM classified c JOIN marked m ON m.session = c.session AND m.frame_id = c.frame_id"""
)
def q_report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified frames through the report's JSON lines and back."""
    f = frames(spark, sf_dir).persist()
    stats = TB.small_table(S.two_pass_stats(f))
    classified = C.with_reference(C.classify_frames(S.mark_outliers(f, S.session_stats(f)), stats))
    back = import_lines(report_lines(classified, stats), ["session"])
    return back.select("session", F.col("filename").cast("long").alias("frame_id"), "flag", F.array_join("triggered_by", ",").alias("triggered_by"), "rejection_category", "star_count", "outlier", "is_reference")


@query(
    f"""WITH {sql.STATS} SELECT session, metric, round(mean, 6) AS mean, round(stddev, 6) AS stddev FROM (SELECT session, unnest(['background_median', 'fwhm', 'eccentricity', 'star_count']) AS metric,
  unnest([bm, fm, em, sm]) AS mean, unnest([bs, fs, es, ss]) AS stddev FROM stats)"""
)
def q_report_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions' statistics through the report and back."""
    f = frames(spark, sf_dir).persist()
    stats = TB.small_table(S.two_pass_stats(f))
    return rounded(imported_statistics(report_lines(C.classify_frames(f, stats), stats), "line", ["session"]))


@query("SELECT n.n_nationkey, r.r_name FROM nation n JOIN region r ON lower(r.r_name) = lower(CASE WHEN n_nationkey % 2 = 0 THEN 'Asia' ELSE 'euRope' END) WHERE r.r_regionkey >= 0")
def q_find_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by name, capitals or not."""
    asked = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "Asia").otherwise("euRope").alias("wanted"))
    return TB.join_by_name(asked, "wanted", spark.read.parquet(f"{sf_dir}/region.parquet"), "r_name").select("n_nationkey", "r_name")


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY lower(c_name), c_name) AS place FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS c_name FROM customer)")
def q_ordered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a list ordered by name, capitals or not: rows are sorted by range, and places counted on from range to range."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"))
    return TB.placed(TB.by_name(c, "c_name"), "place").select("c_custkey", "c_name", "place")


@query(f"WITH {sql.FRAMES} SELECT session, frame_id, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN frame_id % 5 = 0 THEN NULL ELSE star_count END DESC NULLS LAST, frame_id) AS place FROM frames")
def q_sorted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a results table sorted by a column that some frames lack; those come last."""
    f = frames(spark, sf_dir).withColumn("shown", F.when(F.col("frame_id") % 5 != 0, F.col("star_count")))
    return RG.ranked(f.select("session", "frame_id", "shown"), "session", [F.col("shown").desc_nulls_last(), F.col("frame_id").asc()], "place").drop("shown")


@query("SELECT o_orderpriority AS session, quantile_disc(o_totalprice, 0.5) AS lower_middle FROM orders GROUP BY 1")
def q_nth_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower middle value of each session."""
    return RG.nth_element(_orders(spark, sf_dir).select(F.col("o_orderpriority").alias("session"), F.col("o_totalprice").alias("lower_middle")), "session", "lower_middle")
