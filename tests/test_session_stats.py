"""Session statistics on small sessions with known outcomes."""

import pytest
from pyspark.sql import functions as F

from framesieve.operators import classify as C
from framesieve.operators import grouping as G
from framesieve.operators import session_stats as S

FRAME = "session string, frame_id long, background_median double, fwhm double, eccentricity double, star_count int"


def session(spark, rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], FRAME)


def test_mean(spark):
    row = S.two_pass_stats(session(spark, [(0.05, 2.5, 0.4, 600), (0.05, 2.7, 0.5, 580), (0.05, 2.6, 0.45, 610)])).first()
    assert row.fwhm_mean == pytest.approx(2.6, abs=0.01) and row.fwhm_sigma > 0


def test_identical_frames_pass(spark):
    rows = C.classify_frames(session(spark, [(0.05, 2.5, 0.4, 600)] * 3)).collect()
    assert all(r.flag == "PASS" and r.triggered_by == [] and r.rejection_category is None for r in rows)


def test_eccentricity_rejects(spark):
    rows = C.classify_frames(session(spark, [(0.05, 2.5, e, 600) for e in (0.4, 0.4, 0.86)])).orderBy("frame_id").collect()
    assert [r.flag for r in rows] == ["PASS", "PASS", "REJECT"] and rows[2].triggered_by == ["Eccentricity"] and rows[2].rejection_category == "O"


def test_null_metrics_never_reject(spark):
    rows = C.classify_frames(session(spark, [(None, None, None, None), (0.05, 2.5, 0.4, 600)])).collect()
    assert all(r.flag == "PASS" for r in rows)


@pytest.mark.parametrize(
    ("names", "expected"),
    [(["FWHM"], "O"), (["StarCount"], "T"), (["BackgroundMedian"], "B"), (["BackgroundMedian", "StarCount"], "BT"), (["FWHM", "StarCount"], "OT"), (["BackgroundMedian", "FWHM"], "OB"), (["BackgroundMedian", "FWHM", "StarCount", "Eccentricity"], "OBT"), (["Other"], "O"), ([], None)],
)
def test_category(spark, names, expected):
    df = spark.createDataFrame([(names,)], "t array<string>")
    assert df.select(C.category(F.col("t")).alias("c")).first().c == expected


def test_bimodality(spark):
    one = [(float(200 + (i - 25) * 2),) for i in range(50)]
    two = [(250.0,)] * 20 + [(50.0,)] * 20
    bc = [spark.createDataFrame(x, "v double").agg(S.bimodality_coefficient("v").alias("b")).first().b for x in (one, two)]
    assert bc[0] < 0.555 < bc[1]


def test_two_clusters_anchor_to_the_better(spark):
    rows = [("s", float(v)) for v in [*range(240, 260), *range(40, 60)]]
    row = S.anchored_stats(spark.createDataFrame(rows, "session string, star_count double"), "session", "star_count").first()
    assert row.anchored and row.star_count_mean > 200


def test_small_clear_cluster_anchors(spark):
    counts = [1850 + i * 13 % 101 for i in range(15)] + [550 + i * 17 % 101 for i in range(50)]
    frames = session(spark, [(0.05, 2.5, 0.4, c) for c in counts])
    rows = C.classify_frames(frames).orderBy("frame_id").collect()
    assert S.anchored_stats(frames, "session", "star_count").first().star_count_mean > 1800
    assert all(r.triggered_by == ["StarCount"] for r in rows[15:])


def test_clear_and_cloudy(spark):
    rows = C.classify_frames(session(spark, [(0.05, 2.5, 0.4, 240 + i * 3 % 21) for i in range(20)] + [(0.05, 2.5, 0.4, 50)] * 15)).orderBy("frame_id").collect()
    assert rows[0].flag == "PASS" and all(r.flag == "REJECT" for r in rows[20:])


def test_scores(spark):
    df = spark.createDataFrame([(6.0, 0.02), (2.2, 0.30), (3.0, None), (None, None)], "fwhm double, eccentricity double")
    a, b, c, d = (r.s for r in df.select(C.quality_score().alias("s")).collect())
    assert b > a and c > 0 and d == 0


def test_empty_session(spark):
    assert C.with_reference(C.classify_frames(session(spark, []).limit(0))).count() == 0


def test_groups(spark):
    rows = [("u", 0, 0.0, 10.0), ("u", 1, 600.0, 15.0), ("u", 2, 9000.0, 18.0), ("u", 3, 18000.0, 30.0), ("u", 4, 18060.0, 200.0), ("u", 5, 18120.0, None), ("u", 6, None, 10.0)]
    df = spark.createDataFrame(rows, "u string, i int, t double, r double")
    groups = {r.i: r.frame_group for r in G.assign_groups(df, "u", "t", "r", "i").collect()}
    assert groups == {6: 0, 0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3}
    assert G.master_group(G.assign_groups(df, "u", "t", "r", "i"), "u").first().master == 0


def test_results_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 300, 1, 3).selectExpr("cast(id % 3 AS string) AS session", "id AS frame_id", "(id % 7) / 10.0D AS background_median", "(id % 11) * 1.0D AS fwhm", "(id % 5) / 10.0D AS eccentricity", "cast(id % 13 AS int) AS star_count", "'PASS' AS flag", "array('x') AS triggered_by", "'O' AS rejection_category")
    results = rows.mapInArrow(counted, rows.schema)
    files = spark.range(0, 330, 1, 2).selectExpr("cast(id % 3 AS string) AS session", "id AS frame_id", "concat('/d/', lpad(id, 4, '0'), '.fit') AS path", "id % 3 = 0 AS imported")
    view = C.results_view(files, results, "frame_id").collect()
    assert len(view) == 330 and sum(r.flag == "" for r in view) == 30 and all(r.triggered_by == ["x"] for r in view if r.session == "0" and r.frame_id < 300)
    assert seen.value == 300
