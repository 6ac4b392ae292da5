"""Queries on sessions of frames: statistics, classification, references, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framesieve.functions import keywords as K
from framesieve.operators import classify as C
from framesieve.operators import grouping as G
from framesieve.operators import ranges as RG
from framesieve.operators import session_stats as S
from framesieve.operators import tables as TB
from framesieve.plans import sql
from framesieve.sources.adapters import frames, headers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str):
    """Registers a function (spark, sf_dir) under its name with the SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0 as 0), so that sums taken in another order compare equal."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("triggered_by", F.array_join("triggered_by", ","))


@query(f"WITH {sql.FRAMES} SELECT session, round(coalesce(avg(fwhm), 0), 6) AS fwhm_mean, round(coalesce(stddev_pop(fwhm), 0), 6) AS fwhm_sigma FROM frames GROUP BY 1")
def q_mean_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames(spark, sf_dir).groupBy("session").agg(*S.mean_and_sigma("fwhm")))


@query(f"WITH {sql.bimodality('events', 'event_type', 'value')} SELECT g AS event_type, round(bc, 6) AS bc FROM bc")
def q_bimodality(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(events.groupBy("event_type").agg(S.bimodality_coefficient("value").alias("bc")))


@query(f"WITH {sql.valley('events', 'event_type', 'value')} SELECT g AS event_type, b AS bin, c AS n FROM h3")
def q_histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.histogram(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value").select("event_type", "bin", "n")


@query(f"WITH {sql.valley('events', 'event_type', 'value')} SELECT g AS event_type, peak1, peak2, valley_bin, round(valley, 6) AS valley, round(depth, 6) AS depth FROM valley")
def q_histogram_valley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.valley(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value"))


@query(
    f"""WITH two AS (SELECT user_id % 5 AS site, CASE WHEN user_id % 2 = 0 THEN value ELSE value / 10 + 500 + 100 * (user_id % 5) END AS level FROM events), {sql.anchored('two', 'site', 'level')}
SELECT g AS site, round(mean, 6) AS level_mean, round(sigma, 6) AS level_sigma, anchored FROM anchored"""
)
def q_anchored_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    level = F.when(user % 2 == 0, F.col("value")).otherwise(F.col("value") / 10 + 500 + 100 * (user % 5))
    two = spark.read.parquet(f"{sf_dir}/events.parquet").select((user % 5).alias("site"), level.alias("level"))
    return rounded(S.anchored_stats(two, "site", "level"))


@query(
    f"""WITH {sql.STATS} SELECT session, round(bm, 6) AS background_median_mean, round(bs, 6) AS background_median_sigma, round(fm, 6) AS fwhm_mean, round(fs, 6) AS fwhm_sigma,
round(em, 6) AS eccentricity_mean, round(es, 6) AS eccentricity_sigma, round(sm, 6) AS star_count_mean, round(ss, 6) AS star_count_sigma, outliers FROM stats"""
)
def q_two_pass_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.two_pass_stats(frames(spark, sf_dir).persist()))


@query(f"WITH {sql.STATS} SELECT session, frame_id FROM marked WHERE outlier")
def q_outlier_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).persist()
    return S.mark_outliers(f, S.session_stats(f)).where("outlier").select("session", "frame_id")


@query(
    f"""WITH {sql.CLASSIFIED} SELECT session, frame_id, round(background_median, 6) AS background_median, round(fwhm, 6) AS fwhm, round(eccentricity, 6) AS eccentricity, star_count,
triggered_by, flag, rejection_category, row_number() OVER (PARTITION BY session ORDER BY (flag = 'PASS') DESC, score DESC, star_count DESC, frame_id DESC) = 1 AS is_reference FROM classified"""
)
def q_classified_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_text(C.with_reference(C.classify_frames(frames(spark, sf_dir).persist()))))


@query(f"WITH {sql.CLASSIFIED} SELECT session, flag, count(*) AS frames FROM classified GROUP BY 1, 2")
def q_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify_frames(frames(spark, sf_dir).persist()).groupBy("session", "flag").agg(F.count("*").alias("frames"))


@query(f"WITH {sql.CLASSIFIED} SELECT coalesce(rejection_category, 'PASS') AS category, count(*) AS frames FROM classified GROUP BY 1")
def q_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify_frames(frames(spark, sf_dir).persist()).groupBy(F.coalesce("rejection_category", F.lit("PASS")).alias("category")).agg(F.count("*").alias("frames"))


@query(f"WITH {sql.STATS} SELECT f.session, frame_id, round(CASE WHEN fs < 1.1920929e-07 THEN 0 ELSE (fwhm - fm) / fs END, 6) AS fwhm_dev FROM frames f JOIN stats s ON f.session = s.session")
def q_sigma_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).persist()
    joined = f.join(S.two_pass_stats(f), "session")
    return rounded(joined.select("session", "frame_id", S.deviation(F.col("fwhm"), F.col("fwhm_mean"), F.col("fwhm_sigma")).alias("fwhm_dev")))


@query(f"WITH {sql.FRAMES} SELECT frame_id, round(1 / greatest(fwhm, 0.1) + (1 - eccentricity), 6) AS score FROM frames")
def q_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames(spark, sf_dir).select("frame_id", C.quality_score().alias("score")))


@query(
    f"""WITH {sql.STATS}, m AS (SELECT session, unnest(['background_median', 'fwhm', 'star_count', 'eccentricity']) AS metric,
  unnest([bm + 2.5 * bs, fm + 2.5 * fs, sm - 1.5 * ss, 0.85]) AS reject_at FROM stats) SELECT session, metric, round(reject_at, 6) AS reject_at FROM m"""
)
def q_reject_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each metric from which a frame is rejected."""
    t, stats = C.THRESHOLDS, S.two_pass_stats(frames(spark, sf_dir).persist())

    def row(metric: str, value):
        return F.struct(F.lit(metric).alias("metric"), value.alias("reject_at"))

    rows = [row(m, F.col(f"{m}_mean") + t[m] * F.col(f"{m}_sigma")) for m in ("background_median", "fwhm")]
    rows += [row("star_count", F.col("star_count_mean") - t["star_count"] * F.col("star_count_sigma")), row("eccentricity", F.lit(t["eccentricity"]))]
    return rounded(stats.select("session", F.explode(F.array(*rows)).alias("r")).select("session", "r.metric", "r.reject_at"))


@query(
    f"""WITH {sql.STATS}, a AS (SELECT f.session, min(fwhm) - 0.15 * (max(fwhm) - min(fwhm)) AS lo, max(fwhm) + 0.15 * (max(fwhm) - min(fwhm)) AS hi FROM frames f GROUP BY 1),
b AS (SELECT s.session, k, unnest([-1, 1]) AS side, fm, fs, lo, hi FROM stats s JOIN a ON a.session = s.session CROSS JOIN (SELECT unnest([1, 2, 3]) AS k))
SELECT session, k AS sigmas, side, round(greatest(lo, least(hi, fm + side * k * fs)), 6) AS level FROM b"""
)
def q_sigma_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines at 1, 2 and 3 deviations around the mean FWHM, held to an axis 15 % wider than the values."""
    f = frames(spark, sf_dir).persist()
    span = F.max("fwhm") - F.min("fwhm")
    axis = f.groupBy("session").agg((F.min("fwhm") - 0.15 * span).alias("lo"), (F.max("fwhm") + 0.15 * span).alias("hi"))
    bands = S.two_pass_stats(f).join(axis, "session").withColumn("sigmas", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    level = F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("fwhm_mean") + F.col("side") * F.col("sigmas") * F.col("fwhm_sigma")))
    return rounded(bands.select("session", "sigmas", "side", level.alias("level")))


@query(
    f"""WITH {sql.CLASSIFIED} SELECT c.session, frame_id, CASE WHEN frame_id % 11 = 0 THEN 'PASS' WHEN frame_id % 13 = 0 THEN 'REJECT' ELSE flag END AS flag FROM classified c"""
)
def q_flag_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags set by hand win over the classifier's; nothing else changes."""
    f = frames(spark, sf_dir).persist()
    key = F.col("frame_id")
    by_hand = f.where((key % 11 == 0) | (key % 13 == 0)).select("frame_id", F.when(key % 11 == 0, "PASS").otherwise("REJECT").alias("flag"))
    return TB.overridden(C.classify_frames(f), by_hand, "frame_id", "flag").select("session", "frame_id", "flag")


@query(f"WITH {sql.CLASSIFIED} SELECT session, frame_id FROM classified WHERE flag <> 'REJECT'")
def q_session_without_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session once rejected frames are moved away."""
    f = frames(spark, sf_dir).persist()
    gone = C.classify_frames(f).where("flag = 'REJECT'").select("frame_id")
    return f.join(gone, "frame_id", "left_anti").select("session", "frame_id")


_GROUPED = f"""{sql.HEADERS}, o AS (SELECT *, epoch(date_trunc('second', ts)) AS t, CASE WHEN rotator IS NOT NULL THEN rotator::DOUBLE END AS r FROM headers), d AS (
  SELECT *, abs(r - lag(r) OVER w) AS turn, coalesce((t - lag(t) OVER w) / 60.0, 0) AS pause, row_number() OVER w AS n FROM o WINDOW w AS (PARTITION BY user_id ORDER BY t NULLS FIRST, event_id)), g AS (
  SELECT *, sum(CASE WHEN n = 1 THEN 0 WHEN coalesce(turn > 90 OR (pause > 120 AND turn > 10), true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t NULLS FIRST, event_id)::BIGINT AS frame_group FROM d)"""


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headers(spark, sf_dir).select("event_id", "user_id", F.unix_timestamp("ts").alias("observed"), K.number(F.col("keywords"), "ROTATOR").alias("rotator"), K.value(F.col("keywords"), "FILTER").alias("filter"), "value")
    return G.assign_groups(h, "user_id", "observed", "rotator", "event_id")


@query(f"WITH {_GROUPED} SELECT event_id, user_id, frame_group FROM g")
def q_frame_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("event_id", "user_id", "frame_group")


@query(f"WITH {_GROUPED}, s AS (SELECT user_id, frame_group, count(*) AS n FROM g GROUP BY ALL) SELECT user_id, arg_max(frame_group, (n, frame_group)) AS master, max(n) AS frames FROM s GROUP BY 1")
def q_master_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.master_group(_grouped(spark, sf_dir), "user_id")


@query(f"WITH {_GROUPED} SELECT event_id, user_id, turn FROM d WHERE n > 1")
def q_rotator_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's turn against the frame before it, null if either angle is unknown."""
    h = headers(spark, sf_dir).select("event_id", "user_id", F.unix_timestamp("ts").alias("observed"), K.number(F.col("keywords"), "ROTATOR").alias("rotator"))
    turned = RG.ranked(h, "user_id", [F.col("observed").asc_nulls_first(), F.col("event_id").asc()], "n", {"before": "rotator"})
    return turned.where("n > 1").select("event_id", "user_id", F.abs(F.col("rotator") - F.col("before")).alias("turn"))


@query(
    f"""WITH {sql.FRAMES}, r AS (SELECT *, frame_id % 3 AS grp, row_number() OVER (PARTITION BY session, frame_id % 3 ORDER BY star_count) AS p, count(*) OVER (PARTITION BY session, frame_id % 3) AS n FROM frames), m AS (
  SELECT session, grp, max(star_count) FILTER (p = n // 2 + 1) AS typical FROM r GROUP BY ALL)
SELECT r.session, r.grp, frame_id, NOT (star_count >= typical * 0.5) AS fallback FROM r JOIN m ON r.session = m.session AND r.grp = m.grp
QUALIFY row_number() OVER (PARTITION BY r.session, r.grp ORDER BY (star_count >= typical * 0.5) DESC, 1 / greatest(fwhm, 0.1) + (1 - eccentricity) DESC, frame_id DESC) = 1"""
)
def q_group_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("grp", F.col("frame_id") % 3)
    return G.group_references(f, ["session", "grp"], "frame_id")


@query(
    f"""WITH {sql.STATS}, s AS (SELECT session, frame_id, fwhm FROM marked WHERE NOT outlier)
SELECT session, frame_id, round(fwhm - lag(fwhm) OVER (PARTITION BY session ORDER BY frame_id), 6) AS step FROM s"""
)
def q_line_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The FWHM's steps from frame to frame, outliers left out."""
    f = frames(spark, sf_dir).persist()
    clean = S.mark_outliers(f, S.session_stats(f)).where("NOT outlier")
    placed = RG.ranked(clean.select("session", "frame_id", "fwhm"), "session", [F.col("frame_id").asc()], before={"before": "fwhm"})
    return rounded(placed.select("session", "frame_id", (F.col("fwhm") - F.col("before")).alias("step")))


@query(f"WITH {sql.CLASSIFIED} SELECT session, frame_id, star_count FROM classified QUALIFY row_number() OVER (PARTITION BY session ORDER BY star_count DESC, frame_id) <= 30")
def q_top_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the 30 frames of most stars in each session."""
    order = W.partitionBy("session").orderBy(F.col("star_count").desc(), "frame_id")
    return frames(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n <= 30").select("session", "frame_id", "star_count")


@query(
    f"""WITH {sql.FRAMES}, c AS (SELECT session, frame_id % 50 = 0 AS a, frame_id % 7 = 0 AS b, star_count FROM frames), r AS (
  SELECT session, NOT a AND NOT b AS included, CASE WHEN a THEN 'FilterMismatch' WHEN b THEN 'AlignmentFailed' END AS reason, star_count * 1.0::DOUBLE AS exposure FROM c)
SELECT session, count(*) AS total, count(*) FILTER (included) AS stacked, count(*) FILTER (reason = 'FilterMismatch') AS filter_excluded, count(*) FILTER (reason = 'AlignmentFailed') AS other_excluded,
  round(sqrt(count(*) FILTER (included)), 6) AS snr, round(coalesce(count(*) FILTER (included) / nullif(count(*) - count(*) FILTER (reason = 'FilterMismatch'), 0)::DOUBLE, 0), 6) AS success,
  coalesce(sum(exposure) FILTER (included), 0) AS exposure FROM r GROUP BY 1"""
)
def q_stack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesieve.operators.stacking import stack_summary

    key = F.col("frame_id")
    reason = F.when(key % 50 == 0, "FilterMismatch").when(key % 7 == 0, "AlignmentFailed")
    contributions = frames(spark, sf_dir).withColumn("exclusion_reason", reason).withColumn("included", F.col("exclusion_reason").isNull()).withColumn("exposure", F.col("star_count").cast("double"))
    return rounded(stack_summary(contributions, ["session"]))


@query(
    f"""WITH {sql.FRAMES}, u AS (SELECT session, frame_id % 20 AS grp, count(*) AS n, stddev_pop(background_median) / nullif(avg(background_median), 0) AS cv FROM frames GROUP BY ALL)
SELECT session, grp, CASE WHEN n < 2 OR cv IS NULL OR cv < 0.05 THEN 'good' WHEN cv < 0.15 THEN 'moderate' ELSE 'poor' END AS uniformity FROM u"""
)
def q_background_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesieve.operators.stacking import background_uniformity

    f = frames(spark, sf_dir).withColumn("grp", F.col("frame_id") % 20)
    return f.groupBy("session", "grp").agg(background_uniformity("background_median").alias("uniformity"))
