import numpy as np
import pytest
from pyspark.sql import functions as F

from framesieve.operators import registration as R
from framesieve.plans.star_queries import QUERIES, _peaks


def spot(size, x, y, sigma=3.0):
    yy, xx = np.mgrid[:size, :size]
    return np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * sigma**2))


@pytest.mark.parametrize(("size", "dx", "dy", "off"), [(256, 20, -15, 2), (512, 50, -30, 2), (1600, 50, -30, 4)])
def test_shift(size, dx, dy, off):
    found = R.correlate(spot(size, size / 2, size / 2), spot(size, size / 2 + dx, size / 2 + dy))
    assert abs(found[0] - dx) < off and abs(found[1] - dy) < off


def test_turn_and_shift_are_found(spark):
    rng = np.random.default_rng(4)
    f = rng.uniform(0, 900, (25, 2))
    a, b, tx, ty = np.cos(0.005), np.sin(0.005), 12.0, -7.0
    r = np.stack([a * f[:, 0] - b * f[:, 1] + tx, b * f[:, 0] + a * f[:, 1] + ty], axis=1)
    r[:3] += rng.uniform(5, 9, (3, 2))  # three wrong ones
    schema = "pair long, star_id long, x double, y double"
    stars, references = (spark.createDataFrame([(7, i, float(x), float(y)) for i, (x, y) in enumerate(p)], schema) for p in (f, r))
    row = R.estimate_transforms(stars, references, spark.createDataFrame([(7, -10.0, 5.0)], "pair long, dx double, dy double"), "pair").first()
    assert row.inliers >= 15 and [row.a, row.b] == pytest.approx([a, b], abs=1e-3) and [row.tx, row.ty] == pytest.approx([tx, ty], abs=0.5)
    assert R.robust_similarity(f[:7], r[:7], -10.0, 5.0) is None


def test_free_references(spark, sf):
    assert R.pick_one_to_one(np.array([[0.0, 0], [1, 0], [50, 0]]), np.array([[0.9, 0], [3, 0]]), 5) == [(0, 0), (1, 1)]
    rows = QUERIES["q_one_to_one"](spark, sf).collect()
    assert len({(r.pair, r.ref_id) for r in rows}) == len(rows) > 0
    peaks = {}
    for p in _peaks(spark, sf).collect():
        peaks.setdefault(p.vec_id, []).append((p.star_id, p.x, p.y))
    for pair in range(5):
        left, right = (sorted(peaks[2 * pair + k]) for k in (0, 1))
        expected = R.pick_one_to_one(np.array([s[1:] for s in left], float), np.array([s[1:] for s in right], float), 3.0)
        assert sorted((r.star_id, r.ref_id) for r in rows if r.pair == pair) == sorted((left[i][0], right[j][0]) for i, j in expected)


def test_stack(spark):
    frames = [(0, k, spot(48, 24 + dx, 24 + dy, 2.0).ravel().tolist()) for k, (dx, dy) in enumerate([(0, 0), (3, -2), (-2, 4)])]
    df = spark.createDataFrame([(*f, "Ha") for f in frames] + [(0, 3, [0.9] * 48 * 48, "OIII")], "grp long, frame long, pixels array<double>, filter string")
    into = R.contributions(df, df.where("frame = 0"), "grp", "frame", 48, 48)
    by_frame = {r.frame: r for r in into.collect()}
    assert by_frame[3].exclusion_reason == "FilterMismatch" and not by_frame[3].included and (by_frame[0].tx, by_frame[0].ty, by_frame[0].a) == (0, 0, 1)
    assert abs(by_frame[1].tx + 3) < 1 and abs(by_frame[1].ty - 2) < 1
    rows = R.stack_frames(df, into, "grp", "frame", 48, 48, crop=False).collect()
    best = max(rows, key=lambda r: r.stacked)
    assert len(rows) == 48 * 48 and abs(best.x - 24) <= 1 and abs(best.y - 24) <= 1 and best.stacked > 0.8 and max(r.n for r in rows) == 3
    cropped = R.stack_frames(df, into, "grp", "frame", 48, 48).collect()
    assert 40 * 40 < len(cropped) < 48 * 48 and {(r.x, r.y, round(r.stacked, 9)) for r in cropped} <= {(r.x, r.y, round(r.stacked, 9)) for r in rows}


def test_turned_frames_are_stacked_turned(spark):
    rng = np.random.default_rng(6)
    size, spots = 128, rng.uniform(22, 106, (14, 2))
    angle, tx, ty = 0.012, 3.0, -2.0
    turned = np.stack([np.cos(angle) * spots[:, 0] + np.sin(angle) * spots[:, 1], np.cos(angle) * spots[:, 1] - np.sin(angle) * spots[:, 0]], axis=1) + (tx, ty)
    images = [sum(spot(size, x, y, 1.6) for x, y in places) for places in (spots, turned)]
    df = spark.createDataFrame([(1, k, (v * 0.5 + 0.05).ravel().tolist(), None) for k, v in enumerate(images)], "grp long, frame long, pixels array<double>, filter string")
    stars = spark.createDataFrame([(1, k, i, float(x), float(y)) for k, places in enumerate((spots, turned)) for i, (x, y) in enumerate(places)], "grp long, frame long, star_id long, x double, y double")
    row = R.contributions(df, df.where("frame = 0"), "grp", "frame", size, size, stars).where("frame = 1").first()
    assert np.arctan2(row.b, row.a) == pytest.approx(angle, abs=1e-3)
    back = np.stack([row.a * turned[:, 0] - row.b * turned[:, 1] + row.tx, row.b * turned[:, 0] + row.a * turned[:, 1] + row.ty], axis=1)
    assert np.abs(back - spots).max() < 0.5
    into = R.contributions(df, df.where("frame = 0"), "grp", "frame", size, size, stars)
    stacked = {(r.x, r.y): r.stacked for r in R.stack_frames(df, into, "grp", "frame", size, size).collect()}
    shown = [stacked.get((round(x), round(y))) for x, y in spots]
    assert sum(v is not None and v > 4 for v in shown) >= 10


def test_queries_give_rows(spark, sf):
    assert QUERIES["q_phase_shift"](spark, sf).count() == 250 and QUERIES["q_stack_frames"](spark, sf).count() == 640 and QUERIES["q_contributions"](spark, sf).count() == 500


def turned_by(points, angle, tx, ty, scale=1.0):
    a, b = scale * np.cos(angle), scale * np.sin(angle)
    return np.stack([a * points[:, 0] - b * points[:, 1] + tx, b * points[:, 0] + a * points[:, 1] + ty], axis=1)


def back(points, angle, tx, ty):
    """Where turned_by(., angle, tx, ty) came from."""
    return turned_by(points - (tx, ty), -angle, 0, 0)


@pytest.mark.parametrize(("angle", "tx", "ty", "scale"), [(0.0, 0, 0, 1), (0.3, 40, -25, 1), (np.pi, 900, 700, 1), (1.83, 500, 100, 1.015), (-0.004, 3, 2, 0.99)])
def test_triangles_register_any_turn(angle, tx, ty, scale):
    rng = np.random.default_rng(8)
    stars = rng.uniform(0, 900, (40, 2))
    references = turned_by(stars, angle, tx, ty, scale) + rng.normal(0, 0.1, (40, 2))
    shuffled = np.concatenate([rng.permutation(references[3:28]), rng.uniform(0, 900, (5, 2)), references[28:]])  # other order, some lost, some new
    a, b, x, y, inliers = R.triangle_similarity(stars, shuffled)
    assert [a, b] == pytest.approx([scale * np.cos(angle), scale * np.sin(angle)], abs=2e-3) and [x, y] == pytest.approx([tx, ty], abs=1) and inliers >= 30
    near, mean = R.residual(stars, shuffled, a, b, x, y)
    assert near >= 30 and mean < 1


def test_triangles_without_a_match():
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 500, (20, 2))
    assert R.triangle_similarity(p[:2], p) is None and R.triangle_similarity(p[:0], p[:0]) is None
    assert R.triangle_similarity(p, np.repeat(p[:1], 20, axis=0)) is None
    assert R.triangle_similarity(p, p * (1, -1)) is None  # mirrored
    assert R.triangle_similarity(p, p * 1.2) is None  # of another scale
    assert R.residual(p[:0], p, 1, 0, 0, 0) == (0, None) and R.residual(p, p + 5000, 1, 0, 0, 0) == (0, None)


def test_turns_without_a_rotator(spark):
    from framesieve.operators.grouping import assign_groups

    rng = np.random.default_rng(5)
    sky = rng.uniform(0, 600, (25, 2))
    angles = [0.0, 0.02, 2.5, 2.5]
    stars = [("s", k, i, float(x), float(y)) for k, angle in enumerate(angles) for i, (x, y) in enumerate(turned_by(sky, angle, 10.0 * k, 0))]
    stars += [("s", 4, 0, 1.0, 1.0)]  # a frame of one star
    stars = spark.createDataFrame(stars, "session string, frame long, star_id long, x double, y double")
    frames = spark.createDataFrame([("s", k, 60.0 * k, 5.0 if k in (2, 3) else None) for k in range(5)], "session string, frame long, t double, rotator double")
    turns = {r.frame: r.matched_turn for r in R.matched_turns(frames, stars, "session", "frame", "t", "rotator").collect()}
    assert turns == {1: pytest.approx(np.degrees(0.02), abs=0.01), 2: pytest.approx(np.degrees(2.48), abs=0.01)}  # 3 has angles, 4 no match
    known = frames.join(R.matched_turns(frames, stars, "session", "frame", "t", "rotator"), ["session", "frame"], "left")
    grouped = assign_groups(known, "session", "t", "rotator", "frame", "matched_turn")
    assert {r.frame: r.frame_group for r in grouped.collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_groups_of_other_orientation_are_stacked_together(spark):
    rng = np.random.default_rng(12)
    size, sky = 160, rng.uniform(15, 145, (22, 2))
    moves = {("m", 0): (0.0, 0.0, 0.0), ("m", 1): (0.0, 2.0, -1.0), ("n", 2): (np.pi, 161.0, 158.0), ("n", 3): (np.pi, 159.0, 160.0)}
    places = {k: turned_by(sky, *move) for k, move in moves.items()}
    places[("o", 4)] = rng.uniform(15, 145, (22, 2))  # another sky
    heights = rng.uniform(0.4, 0.9, len(sky))
    images = {k: 0.05 + sum(h * spot(size, x, y, 1.6) for h, (x, y) in zip(heights, p, strict=True)) for k, p in places.items()}
    frames = spark.createDataFrame([("s", g, k, "Ha", v.ravel().tolist()) for (g, k), v in images.items()], "session string, grp string, frame long, filter string, pixels array<double>")
    order = np.argsort(-heights)
    stars = spark.createDataFrame([(g, k, i, float(p[j, 0]), float(p[j, 1])) for (g, k), p in places.items() for i, j in enumerate(order)], "grp string, frame long, star_id long, x double, y double")
    references = spark.createDataFrame([("s", "m", 0), ("s", "n", 2), ("s", "o", 4)], "session string, grp string, frame long")
    masters = spark.createDataFrame([("s", "m")], "session string, grp string")
    crossed = R.cross_transforms(frames, stars, references, masters, "session", "grp", "frame", size, size)
    rows = {r.grp: r for r in crossed.collect()}
    assert rows["m"].solved and (rows["m"].a, rows["m"].tx) == (1, 0) and not rows["o"].solved
    assert rows["n"].solved and rows["n"].matched == 22 and rows["n"].mean_residual < 0.1 and np.cos(np.arctan2(rows["n"].b, rows["n"].a) - np.pi) > 0.9999
    own = R.contributions(frames, references, "grp", "frame", size, size, stars)
    into = R.across_groups(own, crossed, "session", "grp", "frame")
    outcome = {r.frame: r for r in into.collect()}
    assert {k: r.exclusion_reason for k, r in outcome.items()} == {0: None, 1: None, 2: None, 3: None, 4: "CrossGroupFailed"}
    for (_, k), move in moves.items():
        r = outcome[k]
        there = turned_by(sky, *move)
        assert np.abs(np.stack([r.a * there[:, 0] - r.b * there[:, 1] + r.tx, r.b * there[:, 0] + r.a * there[:, 1] + r.ty], axis=1) - sky).max() < 0.3
    stacked = {(r.x, r.y): r for r in R.stack_frames(frames, into, "session", "frame", size, size).collect()}
    inside = [stacked[(round(x), round(y))] for x, y in sky if (round(x), round(y)) in stacked]
    assert len(inside) >= 18 and all(r.n == 4 and r.stacked > 4 for r in inside)


def test_a_frame_that_its_stars_do_not_confirm_is_out(spark):
    rng = np.random.default_rng(2)
    sky = rng.uniform(5, 59, (12, 2))
    image = sum(spot(64, x, y, 1.5) for x, y in sky).ravel().tolist()
    frames = spark.createDataFrame([(0, k, None, image) for k in range(3)], "grp long, frame long, filter string, pixels array<double>")
    stars = [(0, k, i, float(x), float(y)) for k in (0, 1) for i, (x, y) in enumerate(sky)] + [(0, 2, 0, 5.0, 5.0)]
    rows = R.contributions(frames, frames.where("frame = 0"), "grp", "frame", 64, 64, spark.createDataFrame(stars, "grp long, frame long, star_id long, x double, y double")).collect()
    assert {r.frame: (r.included, r.exclusion_reason) for r in rows} == {0: (True, None), 1: (True, None), 2: (False, "AlignmentFailed")}


def test_colour_stack(spark):
    rng = np.random.default_rng(1)
    planes = rng.uniform(0.1, 1, (16, 16, 3))
    shifted = np.roll(planes, (2, -3), axis=(0, 1))  # down by 2, left by 3
    frames = spark.createDataFrame([(0, 0, planes.ravel().tolist()), (0, 1, (shifted * 2).ravel().tolist())], "grp long, frame long, pixels array<double>")
    into = spark.createDataFrame([(0, 0, True, 1.0, 1.0, 0.0, 0.0, 0.0), (0, 1, True, 2.0, 1.0, 0.0, 3.0, -2.0)], "grp long, frame long, included boolean, background_level double, a double, b double, tx double, ty double")
    rows = R.stack_frames(frames, into, "grp", "frame", 16, 16, channels=3).collect()
    assert len(rows) == 13 * 14 and all(r.kept == 2 for r in rows)
    for r in rows:
        assert (r.r, r.g, r.b) == pytest.approx(tuple(planes[r.y, r.x]))


def test_skies_are_stacked_by_their_stars(spark, sf):
    from framesieve.plans.star_queries import COPIES, _luma

    rows = QUERIES["q_star_contributions"](spark, sf).collect()
    skies = {r.frame: np.array(r.luma).reshape(64, 64) for r in _luma(spark, sf).collect()}
    assert len(rows) == 4 * len(skies) and {r.exclusion_reason for r in rows if r["copy"] == 3} == {"FilterMismatch"}
    turned = [r for r in rows if r["copy"] in (1, 2) and r.included]
    assert len(turned) >= len(skies)  # a sky of few clear stars may fail
    for r in turned:
        angle, tx, ty, _ = COPIES[r["copy"]]
        x, y = np.array([20.0, 45.0]), np.array([15.0, 40.0])
        there = np.cos(angle) * x - np.sin(angle) * y + tx, np.sin(angle) * x + np.cos(angle) * y + ty
        back = r.a * there[0] - r.b * there[1] + r.tx, r.b * there[0] + r.a * there[1] + r.ty
        assert np.hypot(back[0] - x, back[1] - y).max() < 0.6
    stacked = {}
    for r in QUERIES["q_star_stacks"](spark, sf).collect():
        stacked.setdefault(r.tile, []).append(r)
    used = {t: sum(r.included for r in rows if r.tile == t) for t in {r.tile for r in rows}}
    for tile, own in stacked.items():
        level = next(r.background_level for r in rows if r.tile == tile and r["copy"] == 0)
        assert all(r.n == used[tile] for r in own) and 50 * 50 < len(own) <= 64 * 64
        off = [abs(r.stacked - skies[int(tile)][r.y, r.x] / level) for r in own if int(tile) in skies]
        assert not off or np.median(off) < 0.2


def test_pairs_are_solved_in_batches_and_parts(spark):
    x = spark.range(4_000).select("id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("star_id")).selectExpr("id AS pair", "star_id", "(star_id * 37 % 11) * 20.0 AS x", "(star_id * 23 % 13 + id % 3) * 20.0 AS y").repartition(3)
    moved = x.selectExpr("pair", "star_id", "0.8 * x - 0.6 * y + 31 AS x", "0.6 * x + 0.8 * y - 17 AS y")
    found = R.triangle_transforms(x, moved, "pair")
    rows = found.withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) == 4_000 and all((r.a, r.b, r.tx, r.ty) == pytest.approx((0.8, 0.6, 31, -17)) and r.inliers == 8 for r in rows)
    plan = found._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and len({r.part for r in rows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
