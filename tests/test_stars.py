import numpy as np
import pytest
from pyspark.sql import functions as F

from framesieve.operators import matching as M
from framesieve.operators import stars as S


def frame(spark, image, name="f"):
    return spark.createDataFrame([(name, image.shape[1], image.shape[0], image.ravel().tolist())], "frame string, width int, height int, luma array<double>")


def plus(size, stars):
    image = np.full((size, size), 0.05)
    for x, y, b in stars:
        image[y, x] = b
        for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            image[y + dy, x + dx] = b / 2
    return image


def gauss(size, sx, sy, b=0.8):
    y, x = np.mgrid[:size, :size]
    c = size // 2
    return 0.05 + b * np.exp(-((x - c) ** 2) / (2 * sx**2) - ((y - c) ** 2) / (2 * sy**2))


def flooded(image, given=S.DETECTION):
    """Stars by walking from peak to peak: (cx, cy, peak, box, pixels, fwhm, eccentricity), brightest first."""
    h, w = image.shape
    r = given.radius
    level, spread = S.clipped_background(image.ravel()[::4])
    spread = max(spread, 1e-6)
    inside, seen, found = np.maximum(image - level, 0) >= given.flood * spread, np.zeros((h, w), bool), []
    for y in range(r, h - r):
        for x in range(r, w - r):
            square = image[y - r : y + r + 1, x - r : x + r + 1]
            if not level + given.detect * spread <= image[y, x] < given.saturation or (square >= image[y, x]).sum() > 1 or seen[y, x]:
                continue
            waiting, area = [(y, x)], []
            while waiting:
                j, i = waiting.pop()
                if 0 <= j < h and 0 <= i < w and inside[j, i] and not seen[j, i]:
                    seen[j, i] = True
                    area.append((j, i))
                    waiting += [(j + 1, i), (j - 1, i), (j, i + 1), (j, i - 1)]
            if len(area) < given.least_pixels or image[y, x] - level < given.least_peak:
                continue
            ys, xs = np.array(sorted(area)).T
            v = image[ys, xs] - level
            cx, cy = (v * xs).sum() / v.sum(), (v * ys).sum() / v.sum()
            (xx, xy), (_, yy) = np.cov(np.stack([xs, ys]), aweights=v, ddof=0)
            small, large = np.linalg.eigvalsh([[xx, xy], [xy, yy]])
            wide = xs.max() > xs.min() and ys.max() > ys.min()
            found.append((cx, cy, image[y, x] - level, xs.min(), ys.min(), xs.max(), ys.max(), len(area), S.FWHM_PER_SIGMA * np.sqrt((xx + yy) / 2) if wide else np.nan, np.sqrt(1 - small / large) if large > 0 and small >= 0 else np.nan))
    if len(found) >= 2:
        size, most = sorted(f[7] for f in found)[len(found) // 2], max(f[2] for f in found)
        found = [f for f in found if not (f[7] > 5 * size and f[2] < 0.1 * most)]
    return sorted(found, key=lambda f: -f[2])


@pytest.mark.parametrize("seed", range(12))
def test_stars_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    h, w = rng.integers(5, 90, 2)
    y, x = np.mgrid[:h, :w]
    image = rng.normal(0.1, rng.choice([0.0, 0.002, 0.02]), (h, w))
    for cx, cy, s, b in zip(rng.uniform(0, w, 15), rng.uniform(0, h, 15), rng.uniform(0.7, 4, 15), rng.uniform(0.02, 1.1, 15), strict=True):
        image += b * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * s * s))
    if seed % 3 == 0:
        image = np.round(image, 2)  # plateaus and ties
    given = S.DETECTION if seed % 2 else S.Detection(detect=4, flood=1.5, radius=2, saturation=0.9, least_pixels=3)
    got = S.star_table(image, given).drop(columns="star_id").to_numpy(float)
    want = np.array(flooded(image, given), float).reshape(-1, 10)
    assert got.shape == want.shape
    np.testing.assert_allclose(got[:, :9], want[:, :9], rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(np.nan_to_num(got[:, 9]) ** 2, np.nan_to_num(want[:, 9]) ** 2, atol=1e-6)


def test_areas_are_joined_however_they_wind():
    rng = np.random.default_rng(1)
    spiral = np.zeros((41, 41), bool)
    y, x, d, step = 0, 0, 0, 40
    for turn in range(40):
        dy, dx = ((0, 1), (1, 0), (0, -1), (-1, 0))[turn % 4]
        for _ in range(step):
            spiral[y, x] = True
            y, x = y + dy, x + dx
        step -= 2 * (turn % 2) if turn > 1 else 0
        if step <= 0:
            break
    for mask in (spiral, np.zeros((3, 5), bool), np.ones((4, 1), bool), *(rng.random((30, 37)) < q for q in (0.3, 0.6, 0.9))):
        start, end, area = S.labelled_runs(mask)
        label = np.full(mask.size, -1)
        for s, e, a in zip(start, end, area, strict=True):
            label[s:e] = a
        label = label.reshape(mask.shape)
        assert ((label >= 0) == mask).all()
        for a, b in ((label[1:], label[:-1]), (label[:, 1:], label[:, :-1])):
            assert (a == b)[(a >= 0) & (b >= 0)].all()
        for one in set(label[mask].tolist()):  # and no area has two parts
            part, at = label == one, np.argwhere(label == one)[0]
            reached = np.zeros(mask.shape, bool)
            reached[tuple(at)] = True
            while True:
                more = reached.copy()
                more[1:] |= reached[:-1]
                more[:-1] |= reached[1:]
                more[:, 1:] |= reached[:, :-1]
                more[:, :-1] |= reached[:, 1:]
                more &= part
                if (more == reached).all():
                    break
                reached = more
            assert (reached == part).all()


def test_flat_image_has_no_stars(spark):
    assert S.detect_stars(frame(spark, np.full((100, 100), 0.05))).count() == 0


def test_one_star(spark):
    row = S.detect_stars(frame(spark, plus(100, [(50, 40, 0.8)]))).first()
    assert abs(row.cx - 50) < 0.1 and abs(row.cy - 40) < 0.1 and row.pixel_count == 5


def test_stars_by_brightness_and_saturation(spark):
    rows = S.detect_stars(frame(spark, plus(200, [(50, 50, 0.65), (150, 50, 0.8), (50, 150, 0.7), (150, 150, 0.75), (100, 100, 0.99)]))).orderBy("star_id").collect()
    assert [round(r.peak + 0.05, 2) for r in rows] == [0.8, 0.75, 0.7, 0.65]


@pytest.mark.parametrize(("sx", "sy", "fwhm", "low", "high"), [(2, 2, 4.71, 0, 0.15), (3, 3, 7.07, 0, 0.15), (5, 1.2, None, 0.9, 1)])
def test_shapes(spark, sx, sy, fwhm, low, high):
    image = gauss(101, sx, sy) + np.random.default_rng(0).normal(0, 1e-4, (101, 101))
    row = S.detect_stars(frame(spark, image)).first()
    assert low <= row.eccentricity <= high and (fwhm is None or row.fwhm == pytest.approx(fwhm, abs=0.3))


def test_moments_in_long_form(spark):
    image = gauss(31, 2, 2) - 0.05
    rows = [(1, int(x), int(y), float(image[y, x])) for y in range(31) for x in range(31)]
    row = S.moment_shapes(spark.createDataFrame(rows, "star int, x int, y int, w double"), ["star"]).first()
    assert row.cx == pytest.approx(15) and row.fwhm == pytest.approx(4.71, abs=0.1) and row.eccentricity < 0.05


def test_transform_is_recovered(spark):
    rng = np.random.default_rng(2)
    f = rng.uniform(0, 500, (10, 2))
    a, b, tx, ty = np.cos(0.005), np.sin(0.005), 12.0, -7.0
    rows = [(0, float(x), float(y), float(a * x - b * y + tx), float(b * x + a * y + ty)) for x, y in f]
    row = M.similarity_of_pairs(spark.createDataFrame(rows, "pair int, fx double, fy double, rx double, ry double"), ["pair"]).first()
    assert [row.a, row.b, row.tx, row.ty] == pytest.approx([a, b, tx, ty], abs=1e-6)


def test_triangles_match_after_a_turn(spark):
    f = np.random.default_rng(5).uniform(0, 400, (6, 2))
    turn = np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]])
    stars = lambda p: spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(p)], "frame int, star_id int, x double, y double")
    left, right = (M.triangles(stars(p), ["frame"]) for p in (f, f @ turn.T + 30))
    assert left.count() == 20
    same = M.match_triangles(left, right, ["frame"]).where("i = ri AND j = rj AND k = rk")
    assert same.count() == 20 and same.agg(F.max("gap")).first()[0] < 1e-9


def test_nearest(spark):
    schema = "frame int, star_id int, x double, y double"
    left = spark.createDataFrame([(0, 0, 9.9, 10.0), (0, 1, 100.0, 100.0)], schema)
    right = spark.createDataFrame([(0, 5, 10.1, 10.0), (0, 6, 12.0, 10.0)], schema)
    assert [(r.star_id, r.ref_id) for r in M.nearest(left, right, ["frame"]).collect()] == [(0, 5)]


def profile(size, x, y, a, b, amplitude, border=0.0):
    yy, xx = np.mgrid[:size, :size]
    return border + amplitude * (1 + ((xx - x) / a) ** 2 + ((yy - y) / b) ** 2) ** -S.EXPONENT


def test_profiles(spark):
    found = S.fit_profile(profile(31, 15.3, 14.8, 4.0, 3.0, 0.7), 15, 15)
    assert found[:5] == pytest.approx([0.7, 15.3, 14.8, 4.0, 3.0], abs=1e-3) and found[5] < 1e-4
    assert found[6] == pytest.approx(0.7, abs=1e-3)  # no background: the weight is the amplitude
    noisy = profile(31, 15, 15, 3.0, 5.0, 0.5) + np.random.default_rng(1).normal(0, 0.01, (31, 31))
    assert S.fit_profile(noisy, 14, 16)[:5] == pytest.approx([0.5, 15, 15, 5.0, 3.0], rel=0.05)
    assert S.fit_profile(np.ones((2, 9)), 1, 1) is None
    assert S.fit_profile(profile(41, 20, 20, 25.0, 1.0, 0.5), 20, 20) is None  # a trail
    assert S.fit_profile(np.random.default_rng(2).uniform(0, 1, (15, 15)), 7, 7) is None
    image = 0.05 + profile(64, 20.4, 30.2, 4.0, 4.0, 0.6) + profile(64, 45.0, 40.7, 4.0, 4.0, 0.3) + np.random.default_rng(3).normal(0, 1e-3, (64, 64))
    frames = spark.createDataFrame([("f", 64, 64, image.ravel().tolist())], "frame string, width int, height int, luma array<double>")
    rows = sorted(S.star_profiles(frames).collect(), key=lambda r: r.star_id)
    assert [(r.star_id, round(r.cx, 1), round(r.cy, 1)) for r in rows] == [(0, 20.4, 30.2), (1, 45.0, 40.7)]
    assert [r.amplitude for r in rows] == pytest.approx([0.6, 0.3], rel=0.05) and [r.major for r in rows] == pytest.approx([4, 4], rel=0.1)
    assert S.star_profiles(frames.limit(0)).collect() == []


def test_stars_of_the_tables_are_found(spark, sf):
    from framesieve.plans.star_queries import QUERIES, star_places

    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    tiles = {}
    for k in range(-(-len(table) // 64)):
        tile = np.full(4096, 0.5)
        rows = np.array([(np.array(r.embedding, float) + 1) / 2 for r in table[64 * k : 64 * k + 64]]).astype(np.float32)
        tile[: rows.size] = rows.ravel()
        tiles[str(k)] = star_places(tile.reshape(64, 64))
    for name, x, y in (("q_detected_stars", "cx", "cy"), ("q_star_profiles", "cx", "cy")):
        found = QUERIES[name](spark, sf).collect()
        assert len(found) >= 6 * len(tiles) and {r.frame for r in found} == tiles.keys()
        near = [min(np.hypot(r[x] - i, r[y] - j) for i, j, _ in tiles[r.frame]) for r in found]
        assert np.quantile(near, 0.8) < 0.5
    analysed = QUERIES["q_analyze_images"](spark, sf).collect()
    assert len(analysed) == len(tiles) and all(r.star_count > 0 and r.fwhm is not None for r in analysed)
