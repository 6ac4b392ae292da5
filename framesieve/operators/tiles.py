"""Frames combined tile by tile: samples stay in arrays and cross the network once.

A frame is cut into tiles where it is; the tiles of one place meet in one task, which takes means and deviations over the frames, clips, and averages
what is left. How large a tile is follows from how many frames a group has, so that a task holds about TASK_BYTES of samples whatever that number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Deviations within which a pixel's value counts, and a deviation below which all do.
CLIP, LEAST_SIGMA = 2.5, 1e-10
#: Bytes of samples that a task holds at a time; pixels of the largest and smallest tile.
TASK_BYTES, MOST_PIXELS, LEAST_PIXELS = 48 << 20, 1 << 16, 16
#: Bytes of frames that a worker is sent, and takes up, at a time; one frame at least.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Arrow batches of frames of about ``size`` bytes, as a task has several workers with a batch, its results and those of others at once; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    count, unit = re.match(r"(-?\d+)([bkmgt]?)", spark.conf.get(name).lower()).groups()
    if not 0 < int(count) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit, 0) <= size:
        spark.conf.set(name, str(size))


def frame_pieces(batches: Iterator[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, whatever their size, cut between rows into pieces of about ``size`` bytes; none is empty."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tile_pixels(frames: int, channels: int = 1) -> int:
    """Pixels of a tile of which ``frames`` frames fit a task."""
    return int(min(max(TASK_BYTES // (8 * channels * max(frames, 1)), LEAST_PIXELS), MOST_PIXELS))


def cut_tiles(frames: DataFrame, by: list[str], size: int, channels: int = 1, pixels: str = "pixels") -> DataFrame:
    """(by, first, samples): stretches of ``size`` pixels of every frame, row-major from pixel ``first`` on; the last one is shorter. Samples of a pixel stay together.

    Null and not finite samples become nan. A null array has no tile.
    """
    columns = [f"c{i}" for i in range(len(by))]
    given = frames.where(F.col(pixels).isNotNull()).select(*(F.col(c).alias(n) for c, n in zip(by, columns, strict=True)), F.col(pixels).cast("array<double>").alias("pixels"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("first", T.LongType()), T.StructField("samples", T.ArrayType(T.DoubleType()))])
    step = size * channels

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frame_pieces(batches):
            column = batch.column(len(by))
            offsets = column.offsets.to_numpy().astype(np.int64)
            values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False) if len(offsets) else np.zeros(0)
            offsets -= offsets[0]
            n = -(-np.diff(offsets) // step)
            owner = np.repeat(np.arange(len(n)), n)
            at = (np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)) * step
            bounds = np.append(offsets[owner] + at, offsets[-1])
            held = np.where(np.isfinite(values), values, np.nan)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(pa.array(owner)) for i in range(len(by))), pa.array(at // channels), pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(held)).cast(pa.list_(pa.float64()))], names=schema.names
            )

    small_batches(frames.sparkSession)
    tiles = given.mapInArrow(cut, schema)
    return tiles.toDF(*by, "first", "samples")


def _combined(samples: np.ndarray, deciding: int, clip: float) -> tuple[np.ndarray, ...]:
    """(n, mean, sigma, kept, stacked) of each pixel of (frames, pixels, channels); all but the last by the deciding channel."""
    value = samples[..., deciding]
    there = np.isfinite(value)
    n = there.sum(axis=0)
    mean = np.where(there, value, 0.0).sum(axis=0) / np.maximum(n, 1)
    sigma = np.sqrt((np.where(there, value - mean, 0.0) ** 2).sum(axis=0) / np.maximum(n - 1, 1))
    near = there & ((sigma < LEAST_SIGMA) | (np.abs(value - mean) <= clip * sigma))
    kept = near.sum(axis=0)
    good = near[..., None] & np.isfinite(samples)
    stacked = np.where(good, samples, 0.0).sum(axis=0) / np.maximum(good.sum(axis=0), 1)
    return n, np.where(n > 0, mean, np.nan), sigma, kept, stacked


def combine_tiles(tiles: DataFrame, by: list[str], channels: int = 1, clip: float = CLIP, deciding: int | None = None) -> DataFrame:
    """(by, first, n, mean, sigma, kept, stacked) of tiles of one place: arrays by pixel; stacked holds ``channels`` samples a pixel.

    n: frames with a finite sample there; mean, sigma: over these, the sample deviation, 0 for one; kept: frames within ``clip`` deviations of the mean; stacked: their
    mean, 0 if there is none. Of colours the ``deciding`` channel (the second, if not given) keeps or drops a frame's pixel. Groups whose key is null are groups. Tiles are shuffled once, by group and place.
    """
    which = (1 if channels > 1 else 0) if deciding is None else deciding
    keys = [f"c{i}" for i in range(len(by))]
    given = tiles.select(*(F.col(c).alias(n) for c, n in zip(by, keys, strict=True)), "first", "samples")
    kinds = "n array<int>, mean array<double>, sigma array<double>, kept array<int>, stacked array<double>"
    schema = T.StructType([*given.schema.fields[:-1], *T.StructType.fromDDL(kinds).fields])

    def joined(held: list[np.ndarray]) -> list[list[np.ndarray]]:
        n, mean, sigma, kept, stacked = _combined(np.stack(held).reshape(len(held), -1, channels), which, clip)
        return [[n.astype(np.int32)], [mean], [sigma], [kept.astype(np.int32)], [stacked.ravel()]]

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keep, held = None, None, []
        for batch in batches:
            place = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True))
            column = batch.column(len(keys) + 1)
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i, key in enumerate(place):
                if key != now and held:
                    yield made(keep, held)
                    held = []
                if not held:
                    now, keep = key, [c.slice(i, 1) for c in batch.columns[:-1]]
                held.append(values[offsets[i] : offsets[i + 1]])
        if held:
            yield made(keep, held)

    def made(keep: list[pa.Array], held: list[np.ndarray]) -> pa.RecordBatch:
        arrays = [pa.array(x, pa.list_(pa.int32() if x[0].dtype == np.int32 else pa.float64())) for x in joined(held)]
        return pa.RecordBatch.from_arrays([*keep, *arrays], names=schema.names)

    dealt = given.repartition(*keys, "first").sortWithinPartitions(*keys, "first")
    return dealt.mapInArrow(combined, schema).toDF(*by, "first", "n", "mean", "sigma", "kept", "stacked")


def stack_arrays(frames: DataFrame, by: list[str], channels: int = 1, clip: float = CLIP, deciding: int | None = None, pixels: str = "pixels") -> DataFrame:
    """``combine_tiles`` of whole frames (by, pixels); frames of a group have one size. The number of frames of the largest group is counted first."""
    most = frames.groupBy(*by).count().agg(F.max("count")).first()[0] or 1
    return combine_tiles(cut_tiles(frames, by, tile_pixels(most, channels), channels, pixels), by, channels, clip, deciding)


def pixel_rows(tiles: DataFrame, by: list[str], columns: list[str], channels: dict[str, int] | None = None) -> DataFrame:
    """(by, i, columns): one row a pixel of combined tiles; ``channels`` names a column for each place in ``stacked``."""
    count = len(channels or {}) or 1
    spread = tiles.select(*by, "first", F.posexplode("n").alias("_i", "_n"), *(c for c in ("mean", "sigma", "kept", "stacked")))
    values = {c: F.col("_n") if c == "n" else F.get(c, F.col("_i")) for c in columns}
    values |= {name: F.get("stacked", F.col("_i") * max(count, k + 1) + k) for name, k in (channels or {}).items()}
    return spread.select(*by, (F.col("first") + F.col("_i")).alias("i"), *(v.alias(c) for c, v in values.items()))


def whole_images(tiles: DataFrame, by: list[str], width: int, channels: int = 1) -> DataFrame:
    """(by, width, height, channels, pixels): each group's stacked samples as one image; one image is one row, as everywhere, gathered as few arrays rather than as pixels."""
    rows = tiles.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("first", "stacked"))).alias("parts"))
    samples = F.flatten("parts.stacked")
    return rows.select(*by, F.lit(width).alias("width"), F.expr(f"size(flatten(parts.stacked)) div {width * channels}").cast("int").alias("height"), F.lit(channels).alias("channels"), samples.alias("pixels"))
