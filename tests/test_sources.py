import numpy as np
import pytest
from pyspark.sql import functions as F

from framesieve.sources import fits, xisf
from framesieve.sources.images import read_images, write_images
from framesieve.sources.logs import read_logs
from framesieve.sources.reports import export_sessions, import_frames, import_lines, imported_statistics, imported_thresholds, report_lines

KEYS = {"FILTER": ("Ha", "band"), "EXPTIME": ("300.5", None), "GAIN": ("100", "gain"), "OBJECT": ("O'Neil", None), "DATE-OBS": ("2024-01-02T03:04:05", None)}


def image(depth, channels, width=7, height=5, keywords=KEYS):
    top = {"u8": 255, "u16": 65535, "f32": 1}[depth]
    v = np.random.default_rng(1).uniform(0, top, width * height * channels)
    v = v.astype(np.float32) if depth == "f32" else np.floor(v)
    space = "RGB" if channels == 3 else "Bayer" if "BAYERPAT" in keywords else "Mono"
    return {"width": width, "height": height, "channels": channels, "bit_depth": depth, "color_space": space, "keywords": keywords, "pixels": v}


@pytest.mark.parametrize("depth", ["u8", "u16", "f32"])
@pytest.mark.parametrize("channels", [1, 3])
def test_fits_round_trip(depth, channels):
    given = image(depth, channels)
    data = fits.write(given)
    assert len(data) % 2880 == 0
    back = fits.read(data)
    assert np.array_equal(back.pop("pixels"), given.pop("pixels").astype(np.float32)) and back == given
    assert fits.read(data, pixels=False)["pixels"] is None


@pytest.mark.parametrize("depth", ["u8", "u16", "f32"])
@pytest.mark.parametrize("channels", [1, 3])
@pytest.mark.parametrize("compress", [False, True])
def test_xisf_round_trip(depth, channels, compress):
    given = image(depth, channels, 64, 32, KEYS | {"BAYERPAT": ("RGGB", None)} if channels == 1 else KEYS)
    given["pixels"] = np.floor(given["pixels"] / 8) * 8 if depth != "f32" else np.round(given["pixels"] * 8) / 8
    back = xisf.read(xisf.write(given, compress))
    assert np.array_equal(back.pop("pixels"), given.pop("pixels").astype(np.float32)) and back == given


def test_broken_files():
    with pytest.raises(ValueError):
        fits.read(b"nothing")
    with pytest.raises(ValueError):
        xisf.read(b"nothing at all, really")


def test_read_and_write_folders(spark, tmp_path):
    (tmp_path / "a.fit").write_bytes(fits.write(image("u16", 1, keywords=KEYS | {"BAYERPAT": ("RGGB", None)})))
    (tmp_path / "b.xisf").write_bytes(xisf.write(image("f32", 3), True))
    (tmp_path / "c.FITS").write_bytes(b"broken")
    (tmp_path / "d.txt").write_text("no image")
    rows = {r.filename: r for r in read_images(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.fit", "b.xisf", "c.FITS"}
    assert rows["a.fit"].color_space == "Bayer" and rows["b.xisf"].channels == 3 and rows["c.FITS"].error.startswith("unreadable")
    assert rows["a.fit"].keywords["FILTER"] == ("Ha", "band")
    assert all(r.pixels is None for r in read_images(spark, str(tmp_path), pixels=False).collect())
    loaded = read_images(spark, str(tmp_path), pixels=False).where("filename = 'a.fit'")
    assert read_images(spark, str(tmp_path), loaded=loaded).count() == 2
    out = tmp_path / "out"
    done = lambda **k: {r.file: r.written for r in write_images(read_images(spark, str(tmp_path)), str(out), **k).collect()}
    assert done() == {"a.fit": True, "b.fit": True} and done() == {"a.fit": False, "b.fit": False} and done(kind="xisf", compress=True) == {"a.xisf": True, "b.xisf": True}
    back = {r.filename: r for r in read_images(spark, str(out)).collect()}
    for name in ("a.fit", "a.xisf"):
        assert back[name].pixels == rows["a.fit"].pixels and back[name].keywords == rows["a.fit"].keywords


def test_logs(spark, tmp_path):
    (tmp_path / "x.log").write_text("2024-01-02T03:04:05Z  WARN stack: low: coverage\n2024-01-02T03:04:06Z no level\nnot a log line\n")
    rows = {r.line: r for r in read_logs(spark, str(tmp_path)).collect()}
    first, second, third = (rows[k] for k in sorted(rows))
    assert (first.level, first.module, first.message) == ("WARN", "stack", "low: coverage")
    assert (second.level, second.module, second.message) == ("INFO", "", "no level") and (third.level, third.message) == ("RAW", "not a log line")


def test_report(spark):
    frames = spark.createDataFrame([("s", 1, 2.5, 0.4, 600, 0.05, "PASS", [], None), ("s", 2, 9.0, 0.4, 10, 0.05, "REJECT", ["FWHM"], "O")], "session string, frame_id long, fwhm double, eccentricity double, star_count int, background_median double, flag string, triggered_by array<string>, rejection_category string")
    report = export_sessions(frames, ["session"], {"star_count": -1.75})
    back = import_frames(report, "report", ["session"]).orderBy("filename").collect()
    assert [(r.filename, r.flag, r.triggered_by, r.rejection_category) for r in back] == [("1", "PASS", [], None), ("2", "REJECT", ["FWHM"], "O")]
    assert imported_thresholds(report, "report").first().star_count == 1.75
    stats = spark.createDataFrame([("s", *map(float, range(8)))], "session string, " + ", ".join(f"{m}_{s} double" for m in ("background_median", "fwhm", "eccentricity", "star_count") for s in ("mean", "sigma")))
    marked = frames.withColumns({"outlier": F.col("frame_id") == 2, "is_reference": F.col("frame_id") == 1})
    whole, lines = export_sessions(marked, ["session"], stats=stats), report_lines(marked, stats)
    for back in (import_frames(whole, "report", ["session"]), import_lines(lines, ["session"])):
        assert [(r.filename, r.outlier, r.is_reference, r.imported, r.flag) for r in back.orderBy("filename").collect()] == [("1", False, True, True, "PASS"), ("2", True, False, True, "REJECT")]
    for given, column in ((whole, "report"), (lines, "line")):
        assert {(r.metric, r["mean"], r.stddev) for r in imported_statistics(given, column, ["session"]).collect()} == {("background_median", 0, 1), ("fwhm", 2, 3), ("eccentricity", 4, 5), ("star_count", 6, 7)}


def test_log_files_come_newest_first(spark, tmp_path):
    import os

    from framesieve.sources.logs import log_files

    for name, when in (("a.log", 100), ("b.log", 300), ("c.log", 200), ("d.log", 300), ("e.txt", 400)):
        (tmp_path / name).write_text(name)
        os.utime(tmp_path / name, (when, when))
    assert [(r.filename, r.size) for r in log_files(spark, str(tmp_path)).collect()] == [("b.log", 5), ("d.log", 5), ("c.log", 5), ("a.log", 5)]
