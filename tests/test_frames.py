import numpy as np
import pytest
from pyspark.sql import functions as F

from framesieve.functions import arrays as A
from framesieve.operators import frames as FR
from framesieve.operators import stars as S
from framesieve.sources import fits, xisf
from framesieve.sources.images import read_images, rewrite_images, update_headers
from framesieve.sources.reports import write_tsv
from tests.test_registration import spot


@pytest.mark.parametrize("pattern", ["RGGB", "BGGR", "GRBG", "GBRG"])
@pytest.mark.parametrize(("w", "h", "low", "high"), [(31, 18, 0, 1), (18, 31, -0.4, 1.6), (2, 2, 0, 1)])
def test_debayer(spark, pattern, w, h, low, high):
    image = np.random.default_rng(w).uniform(low, high, (h, w))
    colour = FR.debayered(image, pattern)
    assert np.array_equal(FR.rgb_luma(colour), FR.debayered_luma(image, pattern))
    if (w, low) == (31, 0):  # the form on higher-order functions gives the same
        small = image[:6, :7]
        rgb = spark.createDataFrame([(small.ravel().tolist(),)], "v array<double>").select(A.debayer(F.col("v"), 7, 6, pattern).alias("c")).first().c
        assert np.allclose(np.array([tuple(p) for p in rgb]).reshape(6, 7, 3), FR.debayered(small, pattern), atol=1e-12)


def test_moved():
    image = np.zeros((64, 64, 1))
    image[20, 20] = 1
    there = FR.moved(image, 1, 0, 10, -5)
    assert there[15, 30, 0] == 1 and there.sum() == 1
    colour = np.random.default_rng(2).uniform(0, 1, (20, 30, 3))
    assert np.allclose(FR.moved(colour, np.cos(0.1), np.sin(0.1), 2, 1)[..., 1:2], FR.moved(colour[..., 1:2], np.cos(0.1), np.sin(0.1), 2, 1))
    assert np.array_equal(FR.moved(colour, 1, 0, 0, 0), colour)


def test_inner_bounds(spark):
    def inner_bounds(width, height, *t):
        return tuple(FR.with_inner_bounds(spark.createDataFrame([tuple(map(float, t))], "a double, b double, tx double, ty double"), [], width, height).first())

    assert inner_bounds(40, 30, 1, 0, 0, 0) == (0, 0, 40, 30)
    assert inner_bounds(40, 30, 1, 0, 3, -2) == (3, 0, 40, 28)
    assert inner_bounds(40, 30, 1, 0, 100, 0) == (0, 0, 0, 0)
    for angle, tx, ty in ((0.004, 5.3, -7.2), (-0.008, 0.5, 0.5), (np.pi, 399, 299)):
        a, b = np.cos(angle), np.sin(angle)
        x0, y0, x1, y1 = inner_bounds(400, 300, a, b, tx, ty)
        ones = FR.moved(np.pad(np.ones((300, 400, 1)), 0), a, b, tx, ty)
        y, x = np.mgrid[y0:y1, x0:x1]
        sx, sy = a * (x - tx) + b * (y - ty), a * (y - ty) - b * (x - tx)
        assert ones.shape == (300, 400, 1) and (x1 - x0) * (y1 - y0) > 0.85 * 400 * 300
        assert sx.min() > -1e-6 and sy.min() > -1e-6 and sx.max() < 399 + 1e-6 and sy.max() < 299 + 1e-6


def sky(size, level, places, depth="u16", pattern=None, seed=0):
    """An image of stars over a noisy background as a dict for the writers."""
    v = level + np.random.default_rng(seed).normal(0, 0.001, (size, size)) + sum(0.6 * spot(size, x, y, 2.0) for x, y in places)
    v = np.clip(v, 0, 0.97)
    keywords = {"FILTER": ("Ha", None)} | ({"BAYERPAT": (pattern, None)} if pattern else {})
    return {"width": size, "height": size, "channels": 1, "bit_depth": depth, "color_space": "Bayer" if pattern else "Mono", "keywords": keywords, "pixels": np.floor(v.ravel() * 65535) if depth == "u16" else v.ravel().astype(np.float32)}


PLACES = [(20, 20), (60, 25), (40, 70), (75, 75), (22, 60)]


@pytest.fixture
def folder(tmp_path):
    for k in range(6):
        (tmp_path / f"m{k}.fit").write_bytes(fits.write(sky(96, 0.05 + 0.001 * k, PLACES, seed=k)))
    (tmp_path / "x.xisf").write_bytes(xisf.write(sky(96, 0.05, PLACES, "f32", seed=9), True))
    (tmp_path / "bayer.fits").write_bytes(fits.write(sky(96, 0.05, PLACES, pattern="RGGB", seed=8)))
    return tmp_path


def test_files_to_verdicts(spark, folder):
    (folder / "z.fit").write_bytes(fits.write(sky(96, 0.4, PLACES[:1], seed=7)))
    images = read_images(spark, str(folder)).withColumn("session", F.lit("s"))
    rows = {r.filename: r for r in FR.analyze_images(images, "session", "filename", {"background_median": 1.5}).collect()}
    assert len(rows) == 9 and all(rows[n].star_count == 5 for n in ("m0.fit", "x.xisf", "bayer.fits")) and rows["z.fit"].star_count == 1
    assert rows["m0.fit"].fwhm == pytest.approx(2.355 * 2, abs=0.6) and rows["m0.fit"].background_median == pytest.approx(0.05, abs=0.002)
    assert rows["bayer.fits"].background_median == pytest.approx(0.05, abs=0.002)
    assert rows["z.fit"].flag == "REJECT" and rows["m1.fit"].flag == "PASS" and sum(r.is_reference for r in rows.values()) == 1
    one = fits.read((folder / "m2.fit").read_bytes())
    luma = FR.luma_image(one["pixels"], 96, 96, 1, "u16", "Mono", None)
    assert rows["m2.fit"].background_median == S.clipped_background(luma.ravel()[::8])[0] and rows["m2.fit"].detected_stars == len(S.star_table(luma))


def test_unreadable_files_stop_the_analysis(spark, folder):
    (folder / "bad.fit").write_bytes(b"nothing")
    images = read_images(spark, str(folder)).withColumn("session", F.lit("s"))
    with pytest.raises(Exception, match="SOURCE_FILE_MISSING"):
        FR.analyze_images(images, "session", "filename").collect()
    assert FR.frame_metrics(images, ["filename"], abort=False).where("background_median IS NULL").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_images(spark, [str(folder / "m0.fit"), str(folder / "none.fit")]).count()


def test_kinds_of_loading(spark, folder):
    (folder / "c.fit").write_bytes(fits.write(sky(96, 0.05, PLACES) | {"channels": 3, "color_space": "RGB", "pixels": np.arange(96 * 96 * 3) % 65536}))
    images = read_images(spark, str(folder))
    got = {kind: {r.filename: r for r in FR.load(images, kind).collect()} for kind in ("raw", "luma", "color")}
    assert got["raw"]["m0.fit"].loaded[0] > 1 and got["luma"]["m0.fit"].loaded[0] < 1
    assert [got["color"][n].loaded_channels for n in ("m0.fit", "bayer.fits", "c.fit")] == [1, 3, 3] and got["luma"]["bayer.fits"].loaded_channels == 1
    pixel = np.array(got["color"]["c.fit"].loaded[:3])
    assert got["luma"]["c.fit"].loaded[0] == pytest.approx(pixel @ [0.299, 0.587, 0.114])
    whole = {r.filename: r for r in FR.debayer_images(images).collect()}
    assert whole["bayer.fits"].channels == 3 and len(whole["bayer.fits"].pixels) == 96 * 96 * 3 and whole["m0.fit"].channels == 1 and len(whole) == 9


def test_flats(spark, folder):
    images = read_images(spark, str(folder))
    lights = images.where("filename LIKE 'm%'")
    assert FR.check_flat(images.where("filename = 'm0.fit'"), lights).count() == 0
    assert {r.field for r in FR.check_flat(images.where("filename = 'bayer.fits'"), lights).collect()} == {"color_space", "pattern"}


def test_headers_change_in_place(spark, folder):
    before = {r.filename: r for r in read_images(spark, str(folder)).collect()}
    raw = (folder / "m0.fit").read_bytes()
    entry = F.struct(F.lit("M 31").alias("value"), F.lit("what").alias("comment"))
    heads = read_images(spark, str(folder), pixels=False)
    assert all(r.pixels is None and r.error is None and r.width == 96 for r in heads.collect())
    changed = heads.withColumn("keywords", F.map_concat("keywords", F.create_map(F.lit("OBJECT"), entry)))
    changed = spark.createDataFrame(changed.collect(), changed.schema)
    assert all(r.error is None for r in update_headers(changed).collect())
    after = {r.filename: r for r in read_images(spark, str(folder)).collect()}
    assert all(after[n].keywords["OBJECT"] == ("M 31", "what") and after[n].pixels == before[n].pixels and after[n].keywords["FILTER"].value == "Ha" for n in before)
    assert raw[-2880 * 3 :] == (folder / "m0.fit").read_bytes()[-2880 * 3 :]
    dark = spark.createDataFrame([r.asDict() | {"pixels": [0.0] * len(r.pixels)} for r in after.values()], read_images(spark, str(folder)).schema)
    assert rewrite_images(dark).count() == len(after)
    assert all(max(r.pixels) == 0 and r.keywords["OBJECT"].value == "M 31" for r in read_images(spark, str(folder)).collect())
    assert not [p for p in folder.iterdir() if p.name.endswith(".part")]


def test_tsv(spark, tmp_path):
    rows = [("a b", 1, None), ('quo"te', 2, 0.5)]
    write_tsv(spark.createDataFrame(rows, "name string, n int, x double").coalesce(1), f"{tmp_path}/t")
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    assert text.splitlines()[0].split("\t") == ['"name"', '"n"', '"x"'] and '"quo""te"\t"2"\t"0.5"' in text


def test_heat_map(spark):
    rng = np.random.default_rng(3)
    rows = [("many", float(x), float(y), 3 + float(x) / 50) for x, y in rng.uniform(0, 100, (420, 2))] + [("few", 1.0 * i, 2.0 * i, 2.0) for i in range(30)] + [("none", 1.0, 1.0, 2.0)] * 24
    cells = S.heat_map(spark.createDataFrame(rows, "frame string, cx double, cy double, fwhm double"), "frame", 100, 100).collect()
    grids = {r.frame: (r.grid, r.few) for r in cells}
    assert grids == {"many": (7, False), "few": (5, True)} and len(cells) == 49 + 25
    many = [r for r in cells if r.frame == "many"]
    assert min(r.level for r in many) == 0 and max(r.level for r in many) == 10 and all(r.level == 0 for r in cells if r.frame == "few")


def test_stretch_of_whole_images(spark):
    from framesieve.operators.tiles import combine_tiles, cut_tiles, whole_images

    rng = np.random.default_rng(4)
    v = np.clip(rng.normal(0.1, 0.03, (12, 10, 3)), 0, 1)
    v[..., 1] = 0.25  # a flat channel
    one = spark.createDataFrame([("k", v.ravel().tolist())], "grp string, pixels array<double>")
    images = whole_images(combine_tiles(cut_tiles(one, ["grp"], 7, 3), ["grp"], 3), ["grp"], 10, 3)
    row = images.first()
    assert (row.width, row.height, row.channels) == (10, 12, 3) and np.array_equal(np.array(row.pixels).reshape(12, 10, 3), v)
    out = np.array(FR.stretch_images(images, ["grp", "width", "height", "channels"]).first().pixels).reshape(-1, 3)
    for c in range(3):  # the form on higher-order functions gives the same
        one = spark.createDataFrame([(v[..., c].ravel().tolist(),)], "p array<double>")
        assert np.allclose(one.select(A.stretch(F.col("p"), A.stretch_parameters(F.col("p")))).first()[0], out[:, c], atol=1e-9)
    holes = FR.stretched(np.array([[0.1], [np.nan], [0.2], [0.4], [np.inf]]))
    assert np.isnan(holes[1, 0]) and np.isinf(holes[4, 0]) and ((holes[[0, 2, 3], 0] >= 0) & (holes[[0, 2, 3], 0] <= 1)).all()
    assert np.isnan(FR.stretched(np.full((3, 1), np.nan))).all() and np.isfinite(FR.stretched(np.ones((3, 1)))).all()
