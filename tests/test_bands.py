import numpy as np
import pytest
from pyspark.sql import functions as F

from framesieve.operators import bands as B
from framesieve.operators import frames as FR
from framesieve.sources import datasource as DS
from framesieve.sources import fits, xisf
from tests.test_sources import image

BAND = ["filename", "width", "height", "channels", "bit_depth", "row0", "rows", "above", "below", "pixels", "error"]


def put(folder, name, given):
    (folder / name).write_bytes((xisf if name.endswith("xisf") else fits).write(given))
    return given


def joined(rows, name, column="values"):
    own = sorted((r for r in rows if r.filename == name), key=lambda r: r.row0)
    return np.concatenate([np.array(r[column]) for r in own])


@pytest.mark.parametrize(("height", "width"), [(31, 17), (32, 9), (2, 3), (7, 8)])
@pytest.mark.parametrize(("rows", "halo"), [(5, 1), (4, 3), (1, 1), (100, 1)])
def test_mosaics_in_bands(spark, tmp_path, height, width, rows, halo):
    keys = {"BAYERPAT": ("GBRG", None)}
    files = {name: put(tmp_path, name, image(depth, 1, width, height, keys)) for name, depth in (("a.fit", "u16"), ("b.xisf", "u8"))}
    bands = DS.scan_images(spark, str(tmp_path), BAND, rows, halo)
    luma, colour = (B.debayer_bands(bands, ["filename"], "GBRG", k).collect() for k in (True, False))
    for name, given in files.items():
        mosaic = np.asarray(given["pixels"], np.float32).astype(float).reshape(height, width) / FR.DEPTHS[given["bit_depth"]]
        assert np.array_equal(joined(luma, name), FR.debayered_luma(mosaic, "GBRG").ravel())
        assert np.array_equal(joined(colour, name), FR.debayered(mosaic, "GBRG").ravel())


@pytest.mark.parametrize("channels", [1, 3])
def test_luminance_and_blocks_in_bands(spark, tmp_path, channels):
    given = put(tmp_path, "a.fit", image("u16", channels, 23, 37))
    put(tmp_path, "holes.xisf", image("f32", channels, 23, 37) | {"pixels": np.where(np.arange(23 * 37 * channels) % 5 == 0, np.nan, 0.5)})
    whole = np.asarray(given["pixels"]).reshape(37, 23, channels)
    luma = B.luma_bands(DS.scan_images(spark, str(tmp_path), BAND, 6, 2), ["filename"]).collect()
    expected = FR.rgb_luma(whole / 65535) if channels == 3 else whole[..., 0] / 65535
    assert np.array_equal(joined(luma, "a.fit"), expected.ravel())
    for step in (1, 3, 4, 50):
        found = B.reduce_bands(DS.scan_images(spark, str(tmp_path), BAND, 6, 1, align=step), ["filename"], step).collect()
        wanted = FR.reduced_blocks(whole, step)
        assert [r.width for r in found if r.filename == "a.fit"] == [23 // step] * len([r for r in found if r.filename == "a.fit"])
        assert not wanted.size or np.array_equal(joined(found, "a.fit"), wanted.ravel())
    by_hand = [[[whole[4 * j : 4 * j + 4, 4 * i : 4 * i + 4, c].mean() for c in range(channels)] for i in range(5)] for j in range(9)]
    np.testing.assert_allclose(FR.reduced_blocks(whole, 4), by_hand)
    assert np.allclose(joined(found := B.reduce_bands(DS.scan_images(spark, str(tmp_path), BAND, 6, 0, align=4), ["filename"], 4).collect(), "holes.xisf"), 0.5) and found
    assert FR.reduced_blocks(np.full((2, 2, 1), np.nan), 2).tolist() == [[[0.0]]]
    assert [FR.display_step(w) for w in (1200, 1201, 3008, 2400)] == [1, 2, 3, 2]
    with pytest.raises(Exception, match="align=4"):
        B.reduce_bands(DS.scan_images(spark, str(tmp_path), BAND, 6), ["filename"], 4).collect()


@pytest.mark.parametrize("t", [(1, 0, 3.25, -4.5), (np.cos(0.03), np.sin(0.03), 2, -1), (-1, 0, 40, 30), (0.5, 0.1, 3, 3), (1, 0, 500, 0)])
def test_resampling_in_bands(spark, tmp_path, t):
    big = put(tmp_path, "a.fit", image("u16", 3, 41, 333))
    put(tmp_path, "b.xisf", image("u16", 1, 41, 333))
    (tmp_path / "c.fit").write_bytes(b"broken")
    heads = DS.scan_images(spark, str(tmp_path), ["path", "height", "error"])
    transforms = heads.where("error IS NULL").select("path", "height", *(F.lit(float(v)).alias(n) for n, v in zip(("a", "b", "tx", "ty"), t, strict=True)))
    found = B.resample_bands(transforms, 50).withColumn("filename", F.element_at(F.split("path", "/"), -1)).collect()
    whole = FR.moved(np.asarray(big["pixels"], np.float32).astype(float).reshape(333, 41, 3), *map(float, t))
    assert np.array_equal(joined(found, "a.fit"), whole.ravel()) and len(found) == 14 and all(r.error is None for r in found)
    if t[0] == 1 and t[2] < 100:
        assert max(r.bytes_read for r in found if r.filename == "a.fit") < 0.3 * (tmp_path / "a.fit").stat().st_size
