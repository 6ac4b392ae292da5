import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framesieve.sources import datasource as DS
from framesieve.sources import fits, xisf
from framesieve.sources.files import ImageFile
from framesieve.sources.images import read_images
from tests.test_sources import KEYS, image


@pytest.fixture
def folder(tmp_path):
    for k, (depth, channels) in enumerate([("u8", 1), ("u16", 1), ("u16", 3), ("f32", 1), ("f32", 3)]):
        given = image(depth, channels, 40, 31, KEYS | {"FILTER": ("Ha" if k % 2 else "OIII", None), "EXPTIME": (str(100 * k), None)})
        (tmp_path / f"a{k}.fit").write_bytes(fits.write(given))
        (tmp_path / f"b{k}.xisf").write_bytes(xisf.write(given))
        (tmp_path / f"c{k}.xisf").write_bytes(xisf.write(given, True))
    high = image("f32", 1, 9, 7)
    high["pixels"] = np.floor(high["pixels"] * 60000)
    (tmp_path / "high.fits").write_bytes(fits.write(high))
    (tmp_path / "broken.fit").write_bytes(b"nothing")
    (tmp_path / "cut.fit").write_bytes(fits.write(image("u16", 1))[:2880])
    (tmp_path / "note.txt").write_text("no image")
    return tmp_path


def rows(df, *columns):
    return {r.filename: tuple(r[c] for c in columns) for r in df.collect()}


def test_the_same_rows_as_the_binary_reader(spark, folder):
    columns = ["width", "height", "channels", "bit_depth", "color_space", "keywords", "pixels"]
    got = DS.scan_images(spark, str(folder), ["path", "filename", *columns, "error"])
    want = read_images(spark, str(folder))
    assert rows(got.where("error IS NULL"), *columns) == rows(want.where("error IS NULL"), *columns)
    assert rows(got.where("error IS NOT NULL"), "width", "pixels") == {"broken.fit": (None, None), "cut.fit": (None, None)}
    assert set(rows(want.where("error IS NOT NULL"), "error")) == {"broken.fit", "cut.fit"}
    DS.register(spark)
    assert spark.read.format("frames").load(str(folder)).columns == [f.split()[0] for f in "path filename width height channels bit_depth color_space keywords pixels row0 rows above below bytes_read error".split()]
    assert DS.scan_images(spark, str(folder / "missing"), ["path"]).count() == 0


def test_bytes_read(spark, folder):
    sizes = {p.name: p.stat().st_size for p in folder.iterdir()}
    heads = rows(DS.scan_images(spark, str(folder), ["filename", "FILTER", "bytes_read", "error"]).where("error IS NULL"), "FILTER", "bytes_read")
    for name, (_, read) in heads.items():
        with ImageFile(str(folder / name)) as f:
            assert read == f.bytes_read and (name.startswith("c") or read < sizes[name])  # of compressed files the samples may be small
    both = DS.scan_images(spark, str(folder), ["filename", "FILTER", "EXPTIME", "pixels", "bytes_read"])
    one = both.where("FILTER = 'Ha' AND EXPTIME = '100' AND filename LIKE 'a%'")
    assert "pixels" in one.columns and [r.filename for r in one.collect()] == ["a1.fit"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]  # all three are the source's
    assert rows(both.where("EXPTIME IN ('0', '400') AND filename >= 'c'"), "EXPTIME") == {"c0.xisf": ("0",), "c4.xisf": ("400",)}
    assert both.where("upper(FILTER) = 'HA'").count() == 7 and both.where("FILTER IS NULL").count() == 2  # what is not pushed is Spark's; unreadable files have no keys
    left = DS.scan_images(spark, str(folder), ["filename", "FILTER", "bytes_read"]).where("FILTER = 'no such'")
    assert left.count() == 0


@pytest.mark.parametrize(("band_rows", "halo", "align"), [(7, 2, 1), (5, 1, 2), (100, 3, 1), (1, 0, 1), (8, 40, 4)])
def test_bands(spark, folder, band_rows, halo, align):
    bands = DS.scan_images(spark, str(folder), ["filename", "width", "height", "channels", "row0", "rows", "above", "below", "pixels", "bytes_read", "error"], band_rows, halo, align)
    whole = {r.filename: np.array(r.pixels).reshape(r.height, r.width, r.channels) for r in read_images(spark, str(folder)).where("error IS NULL").collect()}
    found = {}
    for r in bands.where("error IS NULL").collect():
        v = np.array(r.pixels).reshape(-1, r.width, r.channels)
        assert np.array_equal(v, whole[r.filename][r.row0 - r.above : r.row0 + r.rows + r.below])
        assert (r.above, r.below) == (min(halo, r.row0), min(halo, r.height - r.row0 - r.rows)) and r.row0 % align == 0
        found.setdefault(r.filename, []).append((r.row0, r.rows))
    assert found.keys() == whole.keys()
    for name, own in found.items():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) == whole[name].shape[0]


def test_a_large_file_is_several_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(DS, "BAND_BYTES", 1000)
    reader = DS.FrameReader(DS.T.StructType.fromDDL("filename string, row0 int, rows int, pixels array<float>, bytes_read long"), {"path": str(folder / "a1.fit"), "bandRows": "4"})
    parts = reader.partitions()
    got = [[(b["row0"][0].as_py(), b["rows"][0].as_py(), b["bytes_read"][0].as_py()) for b in reader.read(p)] for p in parts]
    assert len(parts) == 6 and [r for part in got for r in part] and sum(n for part in got for _, n, _ in part) == 31
    assert all(read == 40 * 2 * n for part in got for first, n, read in part if first)  # a band's own bytes, beside the header


def test_written_files(spark, folder, tmp_path):
    read = DS.scan_images(spark, str(folder), ["filename", "width", "height", "channels", "bit_depth", "keywords", "pixels", "error"]).where("error IS NULL AND filename LIKE 'a%'")
    for kind in ("fit", "xisf"):
        out = str(tmp_path / f"out {kind}")
        read.write.format("frames").option("kind", kind).option("compress", "true").mode("append").save(out)
        assert rows(read, "pixels", "keywords") == {f"{n.rsplit('.', 1)[0]}.fit": v for n, v in rows(DS.scan_images(spark, out, ["filename", "pixels", "keywords"]), "pixels", "keywords").items()}
        assert sorted(p.name for p in (tmp_path / f"out {kind}").iterdir()) == [f"a{k}.{kind}" for k in range(5)]


def test_a_failing_job_leaves_the_folder_as_it_was(spark, folder, tmp_path):
    out = tmp_path / "kept"
    read = DS.scan_images(spark, str(folder), ["filename", "width", "height", "channels", "bit_depth", "keywords", "pixels", "error"]).where("error IS NULL AND filename LIKE 'a%'").drop("error")
    read.write.format("frames").mode("append").save(str(out))
    before = {p.name: (p.read_bytes(), p.stat().st_mtime_ns) for p in out.iterdir()}
    stopped = read.withColumn("channels", F.when(F.col("filename") == "a3.fit", F.raise_error(F.lit("stopped here")).cast("int")).otherwise(F.col("channels"))).repartition(4)
    half = read.withColumn("pixels", F.when(F.col("filename") != "a3.fit", F.col("pixels")))  # a row without samples cannot be written
    twice = read.unionByName(read)
    for bad in (stopped, half, twice):
        with pytest.raises(Exception):  # noqa: B017
            bad.write.format("frames").option("existing", "replace").mode("append").save(str(out))
        assert {p.name: (p.read_bytes(), p.stat().st_mtime_ns) for p in out.iterdir()} == before
    changed = read.withColumn("pixels", F.transform("pixels", lambda v: v * 0))
    with pytest.raises(Exception):  # noqa: B017
        changed.write.format("frames").option("existing", "error").mode("append").save(str(out))
    changed.write.format("frames").mode("append").save(str(out))  # what is there is kept
    assert {p.name: (p.read_bytes(), p.stat().st_mtime_ns) for p in out.iterdir()} == before
    changed.write.format("frames").mode("overwrite").save(str(out))
    assert all(max(r.pixels) == 0 for r in DS.scan_images(spark, str(out), ["pixels"]).collect()) and len(list(out.iterdir())) == 5


@pytest.mark.parametrize(("codec", "arrow"), [("zlib", None), ("zlib+sh", None), ("zstd", "zstd"), ("zstd+sh", "zstd"), ("lz4", "lz4_raw"), ("lz4hc+sh", "lz4_raw"), ("lz4", "lz4_raw")])
def test_codecs(codec, arrow):
    import zlib

    given = image("u16", 1, 33, 21)
    plain = xisf.write(given)
    raw = np.asarray(given["pixels"]).astype("<u2").tobytes()
    data = np.frombuffer(raw, np.uint8).reshape(-1, 2).T.tobytes() if "+sh" in codec else raw
    packed = zlib.compress(data) if arrow is None else pa.compress(data, codec=arrow, asbytes=True)
    item = ":2" if "+sh" in codec else ""
    head = plain[16 : 16 + int.from_bytes(plain[8:12], "little")].decode().replace(f"attachment:4096:{len(raw)}", f"attachment:4096:{len(packed)}").replace("<Image ", f'<Image compression="{codec}:{len(raw)}{item}" ', 1)
    if "<Image " not in head:
        head = head.replace(":Image ", f':Image compression="{codec}:{len(raw)}{item}" ', 1)
    file = (xisf.SIGNATURE + len(head.encode()).to_bytes(4, "little") + bytes(4) + head.encode()).ljust(4096, b"\0") + packed
    assert np.array_equal(xisf.read(file)["pixels"], given["pixels"].astype(np.float32))
