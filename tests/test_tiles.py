import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framesieve.operators import frames as FR
from framesieve.operators import registration as R
from framesieve.operators import tiles as TI


def by_hand(stack, deciding, clip):
    """Clipped means of (frames, pixels, channels), pixel by pixel."""
    out = []
    for p in range(stack.shape[1]):
        v = stack[:, p, deciding]
        good = np.isfinite(v)
        m = v[good].mean() if good.any() else np.nan
        s = v[good].std(ddof=1) if good.sum() > 1 else 0.0
        near = [i for i in np.flatnonzero(good) if s < 1e-10 or abs(v[i] - m) <= clip * s]
        means = [np.mean([x for x in stack[near, p, c] if np.isfinite(x)] or [0.0]) for c in range(stack.shape[2])]
        out.append((int(good.sum()), m, s, len(near), *means))
    return np.array(out)


@pytest.mark.parametrize(("channels", "size"), [(1, 7), (1, 1000), (3, 16), (3, 5)])
def test_combined_tiles(spark, channels, size):
    rng = np.random.default_rng(channels)
    groups = {"a": rng.normal(0.5, 0.1, (9, 33, channels)), None: rng.normal(0.5, 0.1, (1, 20, channels)), "b": np.full((4, 12, channels), 0.25)}
    groups["a"][3, 4:6] = np.nan
    groups["a"][5, 7, 0] = np.inf
    groups["a"][:, 9] = np.nan
    groups["a"][2] += 0.9  # an outlier
    rows = [(g, [float(x) for x in frame.ravel()]) for g, stack in groups.items() for frame in stack] + [("a", None)]
    rows[0][1][0] = None
    groups["a"][0, 0, 0] = np.nan
    frames = spark.createDataFrame(rows, "`the group` string, pixels array<double>").repartition(5)
    tiles = TI.combine_tiles(TI.cut_tiles(frames, ["the group"], size, channels), ["the group"], channels, 1.5)
    names = [f"v{c}" for c in range(channels)]
    got = TI.pixel_rows(tiles, ["the group"], ["n", "mean", "sigma", "kept"], {n: k for k, n in enumerate(names)}).orderBy("the group", "i").toPandas()
    for g, stack in groups.items():
        own = got[got["the group"].isna() if g is None else got["the group"] == g]
        assert own.i.tolist() == list(range(stack.shape[1]))
        np.testing.assert_allclose(own[["n", "mean", "sigma", "kept", *names]].to_numpy(float), by_hand(stack, 1 if channels > 1 else 0, 1.5), rtol=1e-9, atol=1e-12)


def test_tiles_follow_the_number_of_frames(spark):
    assert TI.tile_pixels(1) == TI.MOST_PIXELS and TI.tile_pixels(10**9) == TI.LEAST_PIXELS and TI.tile_pixels(1000, 3) * 1000 * 24 <= TI.TASK_BYTES
    empty = spark.createDataFrame([], "g long, pixels array<double>")
    assert TI.stack_arrays(empty, ["g"]).count() == 0
    plan = TI.combine_tiles(TI.cut_tiles(empty, ["g"], 16), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan  # shuffled once, as arrays


def test_references_beyond_the_broadcast_limit(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 1, (3, 24, 24))
    rows = [(g, k, np.roll(base[g], (k, -2 * k), axis=(0, 1)).ravel().tolist(), None) for g in range(3) for k in range(4)]
    df = spark.createDataFrame(rows, "grp long, frame long, pixels array<double>, filter string")
    first = df.where("frame = 0")
    want = sorted(map(tuple, R.contributions(df, first, "grp", "frame", 24, 24).collect()))
    monkeypatch.setattr(R, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, R.contributions(df, first, "grp", "frame", 24, 24).collect())) == want and len(want) == 12


def test_frames_are_taken_up_in_small_pieces(spark):
    frames = spark.range(0, 600, 1, 1).select("id", F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda v: F.when((v == 7) & (F.col("id") % 50 == 3), None).otherwise(v + F.col("id")).cast("double")).alias("pixels"))
    made = FR.map_frames(frames, ["id"], ["pixels"], lambda v: (v * 2,), "twice array<double>")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    for df in (frames, TI.cut_tiles(frames, ["id"], 4096)):
        rows = df.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in rows) == 600 and max(r.size for r in rows) < 2 * TI.BATCH_BYTES
    table = pa.record_batch({"id": pa.array(range(600)), "v": pa.array([[float(i)] * 4096 for i in range(600)])})
    pieces = list(TI.frame_pieces([table, table.slice(0, 0)]))
    assert len(pieces) > 3 and pa.Table.from_batches(pieces).to_batches()[0].schema == table.schema and sum((p.column(0).to_pylist() for p in pieces), []) == list(range(600))
    got = {r.id: (r.a, r.b, r.n) for r in made.selectExpr("id", "twice[7] AS a", "twice[4095] AS b", "size(twice) AS n").collect()}
    assert all(b == 2 * (4095 + i) and n == 4096 and (a != a if i % 50 == 3 else a == 2 * (7 + i)) for i, (a, b, n) in got.items()) and len(got) == 600
