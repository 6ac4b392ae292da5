import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framesieve.functions import arrays as A
from framesieve.functions import cameras as CA
from framesieve.functions import geometry as GE
from framesieve.functions import keywords as K
from framesieve.functions import paths as P
from framesieve.functions import values as V
from framesieve.operators.stars import clipped_background

values = st.lists(st.floats(0, 1, width=32), min_size=1, max_size=40)


def one(spark, column, **given):
    return spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<double>").alias(k) for k, v in given.items())).select(column.alias("x")).first().x


@settings(max_examples=15, deadline=None)
@given(values)
def test_sigma_clip_is_the_loop(spark, v):
    kept = one(spark, A.sigma_clip(F.col("v"), 1.5), v=v)
    middle, spread = clipped_background(np.sort(np.array(v)), 1.5)
    assert np.median(kept) == pytest.approx(middle, abs=1e-9) and np.std(kept) == pytest.approx(spread, abs=1e-9)


@settings(max_examples=10, deadline=None)
@given(values)
def test_medians(spark, v):
    assert one(spark, A.median(F.col("v")), v=v) == pytest.approx(float(np.median(v)))
    assert one(spark, A.median_upper(F.col("v")), v=v) == pytest.approx(sorted(v)[len(v) // 2])


def test_background_sample(spark):
    sample = [0.1 + i * 0.0005 for i in range(100)] + [0.9] * 10
    b = one(spark, A.background(F.col("v")), v=sample)
    assert b["median"] < 0.15 and b["sigma"] < 0.05


def test_clipping(spark):
    for v, share in (([0.5], 0), ([1.0], 1), ([0.995, 0.5], 0.5), ([], 0)):
        assert one(spark, A.clipped_fraction(F.col("v")), v=v) == share


def brute_debayer(image, pattern):
    h, w = image.shape
    colour = lambda y, x: pattern[(y % 2) * 2 + x % 2]
    mirror = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    at = lambda y, x: image[mirror(y, h), mirror(x, w)]
    out = np.zeros((h, w, 3))
    near = {"cross": [(0, 1), (0, -1), (1, 0), (-1, 0)], "corner": [(1, 1), (1, -1), (-1, 1), (-1, -1)]}
    for y in range(h):
        for x in range(w):
            for k, c in enumerate("RGB"):
                if colour(y, x) == c:
                    v = image[y, x]
                else:
                    steps = [s for kind in ("cross", "corner") for s in near[kind] if colour(y + s[0], x + s[1]) == c]
                    steps = [s for s in steps if s in near["cross"]] or steps
                    v = np.mean([at(y + a, x + b) for a, b in steps])
                out[y, x, k] = min(1, max(0, v))
    return out


@pytest.mark.parametrize("pattern", ["RGGB", "BGGR", "GRBG", "GBRG"])
def test_debayer(spark, pattern):
    image = np.random.default_rng(3).uniform(-0.5, 1.5, (7, 9))
    got = one(spark, A.debayer(F.col("v"), 9, 7, pattern), v=image.ravel().tolist())
    expected = brute_debayer(image, pattern)
    assert np.allclose([[p.r, p.g, p.b] for p in got], expected.reshape(-1, 3))
    luma = one(spark, A.rgb_luminance(A.debayer(F.col("v"), 9, 7, pattern)), v=image.ravel().tolist())
    assert np.allclose(luma, expected.reshape(-1, 3) @ A.LUMA)


def test_transfer_curve(spark):
    at = lambda x, m: one(spark, A.midtone(F.col("x"), F.col("m")), x=float(x), m=float(m))
    assert (at(0, 0.3), at(1, 0.3), at(0.4, 0.5)) == (0, 1, 0.4) and at(0.2, 0.2) == pytest.approx(0.5)


def test_flat(spark):
    assert one(spark, A.flat_divide(F.col("v"), F.col("f")), v=[1.0, 1.0, 1.0], f=[0.0, 1.0, 2.0]) == [10.0, 1.0, 0.5]
    assert one(spark, A.flat_divide(F.col("v"), F.col("f")), v=[1.0], f=[1.0, 2.0]) == [1.0]


def test_cameras(spark):
    at = lambda n: one(spark, CA.pixel_size(F.col("n")), n=n)
    assert at("ZWO ASI533MC Pro") == 3.76 == at("zwo asi533mc") and at("Canon EOS 6D") is None
    assert one(spark, CA.plate_scale(F.col("f"), F.col("s"), F.col("b")), f=805.0, s=3.76, b=2.0) == pytest.approx(1.928, abs=0.01)


def test_paths(spark):
    at = lambda c, p: one(spark, c(F.col("p")), p=p)
    for given, cut in (("m51_ha_17.fts.report", "m51_ha_17.fts"), ("C:\\n1\\Dark.XisF~2", "C:/n1/Dark.XisF"), ("notes\\plan.md", "notes\\plan.md"), ("/n.xisf/of.xisf/master.xisf.tmp", "/n.xisf/of.xisf/master.xisf"), ("", "")):
        assert at(P.stripext, given) == cut
    assert (at(P.basename, "/a/b.fit"), at(P.dirof, "/a/b.fit"), at(P.dirof, "b.fit")) == ("b.fit", "/a", ".")
    assert at(P.frame_label, "light_0042.fit") == "42" and at(P.frame_label, "abc.def_ghijklm.fit") == "_ghijklm"
    assert at(P.report_name, "/x/Light_M31_20240102-030405.fit") == "M31_20240102_analysis.json"
    assert at(P.slug, "My Macro! 2_b") == "My-Macro-2_b"


def test_script_values(spark):
    at = lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert at(V.plus, "5", "5") == "10" and at(V.plus, "a", "5") == "a5" and at(V.plus, "1.5", "1") == "2.5"
    assert at(lambda a, b: V.compare(a, b, "=="), "1.0", "1") and at(lambda a, b: V.compare(a, b, "=="), "abc", "ABC")
    assert at(lambda a, b: V.arithmetic(a, b, "/"), "1", "0") is None and at(lambda a, b: V.arithmetic(a, b, "^"), "2", "3") == 8
    assert [one(spark, V.truth(F.col("a")), a=x) for x in ("", "0", "False", "x")] == [False, False, False, True]
    assert one(spark, V.plain_quotes(F.col("a")), a="“x” ‘y’") == "\"x\" 'y'"


def test_keywords(spark):
    df = spark.sql("SELECT map('FILTER', struct(' Ha ' AS value, 'c' AS comment)) AS k")
    at = lambda c: df.select(c.alias("x")).first().x
    k = F.col("k")
    assert at(K.matches(k, "filter", "HA")) and not at(K.matches(k, "gain", "HA"))
    assert at(K.modified(k, "filter", F.lit("R")))["FILTER"] == ("R", "c") and "GAIN" not in at(K.modified(k, "gain", F.lit("1")))
    assert at(K.copied(k, "filter", "band"))["BAND"] == (" Ha ", "c") and at(K.deleted(k, "filter")) == {}
    with pytest.raises(ValueError):
        K.added(k, "MUCHTOOLONG", F.lit("1"))
    assert at(K.observed_at(F.lit("1970-01-01T00:01:00.999"))) == 60 and at(K.observed_at(F.lit("never"))) is None


def test_transforms(spark):
    t = GE.transform(F.lit(0.8), F.lit(0.6), F.lit(12.0), F.lit(-7.0))
    back = GE.compose(GE.inverse(t), t)
    row = spark.range(1).select(back.alias("t")).first().t
    assert [row.a, row.b, row.tx, row.ty] == pytest.approx([1, 0, 0, 0], abs=1e-12)
    p = spark.range(1).select(GE.solve_two(F.lit(112.0), F.lit(50.0), F.lit(100.0), F.lit(57.0), F.lit(22.0), F.lit(-4.0), F.lit(10.0), F.lit(3.0)).alias("t")).first().t
    assert [p.a, p.b, p.tx, p.ty] == pytest.approx([1, 0, 12, -7], abs=1e-9)
