"""Work on whole frames: each is one row, and one map over Arrow batches does all that needs no other frame.

Nothing here is shuffled. Pixels are row-major; samples of colour frames are interleaved.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from framesieve.functions.arrays import LUMA, MAD_SIGMA
from framesieve.operators.classify import classify_frames, with_reference
from framesieve.operators.stars import clipped_background, star_table
from framesieve.operators.tiles import frame_pieces, small_batches

#: What samples of a depth are divided by; FWHM range of stars that count in a frame's median.
DEPTHS = {"u8": 255.0, "u16": 65535.0, "f32": 1.0}
LEAST_FWHM, MOST_FWHM = 0.5, 50.0
#: Deviations below the median where a stretch clips shadows, and what it brings the median to.
SHADOW_CLIP, TARGET = -2.8, 0.15
#: Fixed value: the width to which images are reduced for display.
DISPLAY_WIDTH = 1200
#: Rows that are resampled at a time.
BAND = 32


def _cells(column: pa.Array) -> list:
    """A column's values; lists as numpy arrays."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    offsets = column.offsets.to_numpy()
    values, offsets = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False), offsets - offsets[0]
    return [values[s:e] if valid else None for s, e, valid in zip(offsets, offsets[1:], column.is_valid().to_pylist(), strict=False)]


def map_frames(frames: DataFrame, keep: list[str], given: list[str | Column], function: Callable[..., tuple], added: str) -> DataFrame:
    """Columns ``keep`` of frames, and what ``function`` makes of each frame's ``given`` columns: a tuple for the columns ``added`` (DDL)."""
    schema = T.StructType.fromDDL(added)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    plain = frames.select(*keep, *(F.col(c).alias(f"_given{i}") if isinstance(c, str) else c.alias(f"_given{i}") for i, c in enumerate(given)))
    out = T.StructType([*plain.select(*keep).schema.fields, *schema.fields])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frame_pieces(batches):
            rows = [function(*row) for row in zip(*map(_cells, batch.columns[len(keep) :]), strict=True)]
            made = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=out.names)

    small_batches(frames.sparkSession)
    return plain.mapInArrow(mapped, out)


def _quarters(mosaic: np.ndarray, pattern: str) -> Iterator[tuple[tuple[slice, slice], list[np.ndarray]]]:
    """For each of the four places in the pattern: where its pixels are, and their red, green and blue, held to 0..1.

    A missing channel is the mean of the nearest samples of it; beyond an edge the image is mirrored without repeating the edge.
    """
    h, w = mosaic.shape
    wide = np.pad(mosaic, 1, mode="reflect")
    quarters = [[np.ascontiguousarray(wide[i::2, j::2]) for j in (0, 1)] for i in (0, 1)]  # what is beside a pixel of one quarter is in another at the same place or the next
    held = 0.0 <= mosaic.min() and mosaic.max() <= 1.0  # as means of such samples are then

    for place, own in enumerate(pattern):
        top, left = place // 2, place % 2
        where = (slice(top, None, 2), slice(left, None, 2))
        high, long = (h - top + 1) // 2, (w - left + 1) // 2

        def at(dy: int, dx: int) -> np.ndarray:
            i, j = top + 1 + dy, left + 1 + dx
            return quarters[i % 2][j % 2][i // 2 : i // 2 + high, j // 2 : j // 2 + long]

        beside = pattern[place ^ 1]  # the colour of the neighbours in the row
        row, column = (at(0, -1) + at(0, 1)) / 2, (at(-1, 0) + at(1, 0)) / 2
        values = []
        for channel in "RGB":
            if own == channel:
                value = at(0, 0)
            elif channel == "G":
                value = (row + column) / 2
            elif own == "G":
                value = row if beside == channel else column
            else:
                value = (at(-1, -1) + at(-1, 1) + at(1, -1) + at(1, 1)) / 4
            values.append(value if held else np.clip(value, 0.0, 1.0))
        yield where, values


def debayered(mosaic: np.ndarray, pattern: str = "RGGB") -> np.ndarray:
    """(height, width, 3) of a colour mosaic of at least 2 by 2 pixels, bilinearly."""
    out = np.empty((*mosaic.shape, 3))
    for where, values in _quarters(mosaic, pattern):
        for c, value in enumerate(values):
            out[(*where, c)] = value
    return out


def rgb_luma(image: np.ndarray) -> np.ndarray:
    return image[..., 0] * LUMA[0] + image[..., 1] * LUMA[1] + image[..., 2] * LUMA[2]


def debayered_luma(mosaic: np.ndarray, pattern: str = "RGGB") -> np.ndarray:
    """The luminance of ``debayered`` without its planes, equal to the last bit."""
    out = np.empty(mosaic.shape)
    for where, (r, g, b) in _quarters(mosaic, pattern):
        out[where] = r * LUMA[0] + g * LUMA[1] + b * LUMA[2]
    return out


def debayer_frames(frames: DataFrame, keep: list[str], width: int, height: int, pattern: str = "RGGB", pixels: str = "pixels") -> DataFrame:
    """(keep, r, g, b): the planes of every frame's mosaic."""

    def planes(v: np.ndarray) -> tuple:
        image = debayered(v.reshape(height, width).astype(float), pattern)
        return tuple(image[..., c].ravel() for c in range(3))

    return map_frames(frames, keep, [pixels], planes, "r array<double>, g array<double>, b array<double>")


def debayer_luma_frames(frames: DataFrame, keep: list[str], width: int, height: int, pattern: str = "RGGB", pixels: str = "pixels") -> DataFrame:
    """(keep, luma): debayering and luminance in one step."""
    return map_frames(frames, keep, [pixels], lambda v: (debayered_luma(v.reshape(height, width).astype(float), pattern).ravel(),), "luma array<double>")


def _unit(pixels: np.ndarray, depth: str) -> np.ndarray:
    return pixels.astype(float) / DEPTHS[depth]


def luma_image(pixels: np.ndarray, width: int, height: int, channels: int, depth: str, space: str, pattern: str | None) -> np.ndarray:
    """(height, width) of luminance, 0 to 1: a mosaic is debayered, three channels are weighted, of other counts the first is taken."""
    image = _unit(pixels, depth).reshape(height, width, channels)
    if channels == 1 and space == "Bayer" and min(width, height) > 1:
        return debayered_luma(image[..., 0], pattern or "RGGB")
    return rgb_luma(image) if channels == 3 else image[..., 0]


def colour_image(pixels: np.ndarray, width: int, height: int, channels: int, depth: str, space: str, pattern: str | None) -> np.ndarray:
    """(height, width, channels), 0 to 1: a mosaic becomes three channels, others stay as they are."""
    image = _unit(pixels, depth).reshape(height, width, channels)
    return debayered(image[..., 0], pattern or "RGGB") if channels == 1 and space == "Bayer" and min(width, height) > 1 else image


_IMAGE = ["pixels", "width", "height", "channels", "bit_depth", "color_space"]


def _pattern() -> Column:
    return F.upper(F.trim(F.col("keywords")["BAYERPAT"]["value"]))


def load(images: DataFrame, kind: str, keep: list[str] | None = None) -> DataFrame:
    """Image rows (as ``read_images`` gives them) with ``loaded`` (array<double>) and ``loaded_channels``; null where ``error`` is set.

    kind: ``raw`` (samples as they are), ``luma`` (see ``luma_image``) or ``color`` (see ``colour_image``).
    """

    def made(pixels, width, height, channels, depth, space, pattern) -> tuple:
        if pixels is None:
            return None, None
        if kind == "raw":
            return pixels.astype(float), channels
        image = (luma_image if kind == "luma" else colour_image)(pixels, width, height, channels, depth, space, pattern)
        return image.ravel(), 1 if image.ndim == 2 else image.shape[2]

    if kind not in ("raw", "luma", "color"):
        raise ValueError(f"no such kind: {kind}")
    return map_frames(images, keep or [c for c in images.columns if c != "pixels"], [*_IMAGE, _pattern()], made, "loaded array<double>, loaded_channels int")


def debayer_images(images: DataFrame) -> DataFrame:
    """Image rows in which mosaics are colour images of 32-bit floats; others stay as they are."""
    mosaic = (F.col("color_space") == "Bayer") & F.col("pixels").isNotNull()
    colour = load(images.where(mosaic), "color")
    samples = F.transform("loaded", lambda v: v.cast("float"))
    changed = colour.withColumns({"pixels": samples, "channels": F.lit(3), "bit_depth": F.lit("f32"), "color_space": F.lit("RGB")}).select(*images.columns)
    return changed.unionByName(images.where(~F.coalesce(mosaic, F.lit(False))))


METRICS = "background_median double, background_sigma double, fwhm double, eccentricity double, star_count int, detected_stars int"


def frame_metrics(images: DataFrame, keep: list[str], abort: bool = True) -> DataFrame:
    """(keep, background_median, background_sigma, fwhm, eccentricity, star_count, detected_stars) of image rows, each decoded once.

    The background is the clipped median of every eighth pixel of the luminance; FWHM is the median over stars between LEAST_FWHM and
    MOST_FWHM pixels, which star_count counts; eccentricity the median over all. Medians are null without stars. A row with ``error``
    stops the job, as a session is judged whole or not at all; with ``abort`` false its metrics are null.
    """
    given = images
    if abort:
        failed = F.raise_error(F.concat(F.lit("SOURCE_FILE_MISSING or unreadable: "), F.col("path"), F.lit(": "), F.col("error")))
        given = images.withColumn("channels", F.when(F.col("error").isNotNull(), failed.cast("int")).otherwise(F.col("channels")))

    def measured(pixels, width, height, channels, depth, space, pattern) -> tuple:
        if pixels is None:
            return (None,) * 6
        luma = luma_image(pixels, width, height, channels, depth, space, pattern)
        level, spread = clipped_background(luma.ravel()[::8])
        stars = star_table(luma)
        wide = stars.fwhm.dropna()
        wide = wide[(wide > LEAST_FWHM) & (wide < MOST_FWHM)]
        round_ = stars.eccentricity.dropna()
        return level, spread, float(wide.median()) if len(wide) else None, float(round_.median()) if len(round_) else None, len(wide), len(stars)

    return map_frames(given, keep, [*_IMAGE, _pattern()], measured, METRICS)


def analyze_images(images: DataFrame, by: str, key: str, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Frames of sessions ``by`` from image rows to verdicts: metrics, triggered_by, flag, rejection_category and is_reference.

    Every file is decoded once: the metrics, a few numbers a frame, are persisted for the passes over their session's statistics. Any
    unreadable file stops the analysis.
    """
    metrics = frame_metrics(images, [by, key]).persist()
    return with_reference(classify_frames(metrics, thresholds=thresholds, by=by), by=by, order=key)


def frame_maxima(frames: DataFrame, keep: list[str], width: int, height: int, radius: int = 1, pixels: str = "pixels") -> DataFrame:
    """(keep, x, y, v): pixels strictly above all others in the square of ``radius`` around them, clipped at the edges."""

    def peaks(v: np.ndarray) -> tuple:
        image = v.reshape(height, width).astype(float)
        wide = np.pad(image, radius, constant_values=-np.inf)
        peak = np.ones(image.shape, bool)
        for dy in range(2 * radius + 1):
            for dx in range(2 * radius + 1):
                if (dy, dx) != (radius, radius):
                    peak &= image > wide[dy : dy + height, dx : dx + width]
        y, x = np.nonzero(peak)
        return ([{"x": int(i), "y": int(j), "v": float(image[j, i])} for i, j in zip(x, y, strict=True)],)

    found = map_frames(frames, keep, [pixels], peaks, "found array<struct<x: int, y: int, v: double>>")
    return found.select(*keep, F.explode("found").alias("p")).select(*keep, "p.x", "p.y", "p.v")


def moved(image: np.ndarray, a: float, b: float, tx: float, ty: float) -> np.ndarray:
    """An image (height, width, channels) under x' = a x - b y + tx, y' = b x + a y + ty: each output pixel is read bilinearly where it comes from, edges held."""
    return moved_rows(image, 0, image.shape[0], (0, image.shape[0]), a, b, tx, ty)


def source_rows(rows: tuple[int, int], height: int, width: int, a: float, b: float, tx: float, ty: float) -> tuple[int, int]:
    """The image's rows, from and to before, of which ``moved_rows`` reads for output ``rows``."""
    scale = a * a + b * b
    y = [(a * (j - ty) - b * (i - tx)) / scale for j in (rows[0], rows[1] - 1) for i in (0, width - 1)]
    return min(max(math.floor(min(y)) - 1, 0), height - 1), min(max(math.floor(max(y)) + 3, 1), height)


def moved_rows(image: np.ndarray, top: int, height: int, rows: tuple[int, int], a: float, b: float, tx: float, ty: float) -> np.ndarray:
    """``rows``, from and to before, of ``moved``; ``image`` holds the rows from ``top`` on that they are read from, of an image of ``height`` rows."""
    w = image.shape[1]

    def ends(v: np.ndarray, n: int, first: int = 0) -> list[np.ndarray]:
        return [np.clip(v + i, 0, n - 1) - first for i in (0, 1)]

    if a == 1 and b == 0:  # a shift: one row and one column of weights
        (x0, fx), (y0, fy) = _split(np.arange(w) - tx), _split(np.arange(*rows) - ty)
        (left, right), (upper, lower) = ends(x0, w), ends(y0, height, top)
        across = image[:, left] * (1 - fx)[None, :, None] + image[:, right] * fx[None, :, None]
        return across[upper] * (1 - fy)[:, None, None] + across[lower] * fy[:, None, None]
    out, scale = np.empty((rows[1] - rows[0], *image.shape[1:])), a * a + b * b
    x = np.arange(w)
    for at in range(rows[0], rows[1], BAND):  # what a band needs stays in the cache
        y = np.arange(at, min(at + BAND, rows[1]))[:, None]
        (x0, fx), (y0, fy) = _split((a * (x - tx) + b * (y - ty)) / scale), _split((a * (y - ty) - b * (x - tx)) / scale)
        (left, right), (upper, lower) = ends(x0, w), ends(y0, height, top)
        fx, fy = fx[..., None], fy[..., None]
        above = image[upper, left] * (1 - fx) + image[upper, right] * fx
        below = image[lower, left] * (1 - fx) + image[lower, right] * fx
        out[at - rows[0] : at - rows[0] + BAND] = above * (1 - fy) + below * fy
    return out


def _split(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole parts and fractions."""
    whole = np.floor(v)
    return whole.astype(np.int64), v - whole


def resample_frames(frames: DataFrame, keep: list[str], transform: list[str | Column], width: int, height: int, channels: int = 1, pixels: str = "pixels") -> DataFrame:
    """(keep, pixels): frames of any number of channels moved by their own ``transform`` (a, b, tx, ty)."""

    def made(v: np.ndarray, a: float, b: float, tx: float, ty: float) -> tuple:
        return (moved(v.reshape(height, width, channels).astype(float), a, b, tx, ty).ravel(),)

    return map_frames(frames, keep, [pixels, *transform], made, "pixels array<double>")


def stretched(image: np.ndarray, clip: float = SHADOW_CLIP, target: float = TARGET) -> np.ndarray:
    """An image (pixels, channels), 0 to 1, each channel stretched by its own parameters (see ``arrays.stretch_parameters``); samples that are
    not finite count in none and stay. A channel without finite samples stays."""

    def middle(v: np.ndarray) -> float:
        return float(np.partition(v, len(v) // 2)[len(v) // 2]) if len(v) else 0.0

    def lifted(x: np.ndarray, m: float) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            curve = x if m == 0.5 else (m - 1) * x / ((2 * m - 1) * x - m)
        return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, curve))

    out = image.astype(float)
    for c in range(out.shape[1]):
        good = np.isfinite(out[:, c])
        v = out[good, c]
        if not len(v):
            continue
        level = middle(v)
        shadow = min(max(level + clip * MAD_SIGMA * middle(np.abs(v - level)), 0.0), 1.0)
        rest = max(1 - shadow, 1e-12)
        m = float(lifted(np.array([target]), middle((v[v > shadow] - shadow) / rest))[0])
        out[good, c] = lifted(np.clip((v - shadow) / rest, 0.0, 1.0), m)
    return out


def stretch_images(images: DataFrame, keep: list[str], channels: str | Column = "channels", clip: float = SHADOW_CLIP, target: float = TARGET, pixels: str = "pixels") -> DataFrame:
    """(keep, pixels): whole images, a stack for example (``tiles.whole_images``), with their stretch applied for good at full size, channel by channel."""
    return map_frames(images, keep, [pixels, channels], lambda v, n: (stretched(v.reshape(-1, n), clip, target).ravel(),), "pixels array<double>")


def display_step(width: int, most: int = DISPLAY_WIDTH) -> int:
    """Pixels a side of the blocks that bring a width to ``most`` or less."""
    return -(-width // most) if width > most else 1


def reduced_blocks(image: np.ndarray, step: int) -> np.ndarray:
    """Means of blocks of ``step`` by ``step`` pixels of (height, width, channels): samples that are not finite are left out, a block without others is 0, a remainder at the right and lower edge is dropped."""
    high, wide = image.shape[0] // step, image.shape[1] // step
    blocks = image[: high * step, : wide * step].reshape(high, step, wide, step, image.shape[2])
    good = np.isfinite(blocks)
    return np.where(good, blocks, 0.0).sum(axis=(1, 3)) / np.maximum(good.sum(axis=(1, 3)), 1)


def reduce_images(images: DataFrame, keep: list[str], most: int = DISPLAY_WIDTH, pixels: str = "pixels") -> DataFrame:
    """(keep, step, reduced_width, reduced_height, reduced): images (width, height, channels, pixels) of a width of ``most`` or less, by block means; samples interleaved."""

    def made(v: np.ndarray | None, width: int, height: int, channels: int) -> tuple:
        if v is None:
            return None, None, None, None
        step = display_step(width, most)
        out = reduced_blocks(v.astype(float).reshape(height, width, channels), step)
        return step, out.shape[1], out.shape[0], out.ravel()

    return map_frames(images, keep, [pixels, "width", "height", "channels"], made, "step int, reduced_width int, reduced_height int, reduced array<double>")


def auto_stretch_images(images: DataFrame, keep: list[str], most: int = DISPLAY_WIDTH, clip: float = SHADOW_CLIP, target: float = TARGET) -> DataFrame:
    """(keep, step, reduced_width, reduced_height, stretched) for display: images (width, height, channels, bit_depth, pixels) as fractions, reduced by block means, each channel
    then stretched by its own parameters. Of images that have neither one nor three channels the first is shown."""

    def made(v: np.ndarray | None, width: int, height: int, channels: int, depth: str) -> tuple:
        if v is None:
            return None, None, None, None
        step = display_step(width, most)
        out = reduced_blocks(_unit(v, depth).reshape(height, width, channels)[..., : 3 if channels == 3 else 1], step)
        return step, out.shape[1], out.shape[0], stretched(out.reshape(-1, out.shape[2]), clip, target).ravel()

    return map_frames(images, keep, ["pixels", "width", "height", "channels", "bit_depth"], made, "step int, reduced_width int, reduced_height int, stretched array<double>")


#: Pixels between those that a background takes, the least background that divides, percentiles that a finished stack spans.
EVERY, LEAST_LEVEL, LOW_PERCENT, HIGH_PERCENT = 8, 1.1920929e-07, 0.1, 99.99


def channel_balance(image: np.ndarray, step: int = EVERY, sigma: float = 3.0, rounds: int = 5) -> np.ndarray:
    """What brings the clipped backgrounds of the channels of (pixels, channels), of every ``step``-th pixel, to their mean; ones if a background is none to divide by."""
    levels = np.array([clipped_background(image[::step, c], sigma, rounds)[0] for c in range(image.shape[1])]) if len(image) else np.zeros(image.shape[1])
    return levels.mean() / levels if np.isfinite(levels).all() and (levels > LEAST_LEVEL).all() else np.ones(len(levels))


def finished(image: np.ndarray) -> np.ndarray:
    """A stack (pixels, channels) as it is kept: colours balanced, all channels together brought from LOW_PERCENT and HIGH_PERCENT, by nearest rank, to 0 and 1."""
    balanced = image * channel_balance(image) if image.shape[1] == 3 else image
    ordered = np.sort(balanced[np.isfinite(balanced)])
    if not len(ordered):
        return balanced
    low, high = (ordered[min(int(len(ordered) * p / 100), len(ordered) - 1)] for p in (LOW_PERCENT, HIGH_PERCENT))
    return np.clip((balanced - low) / max(high - low, 1e-6), 0.0, 1.0)


def finish_stacks(images: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, width, height, channels, pixels): stacks (``tiles.whole_images``) balanced and brought to 0..1 (see ``finished``); crop them after that."""
    return map_frames(images, [*keep, "width", "height", "channels"], ["pixels", "channels"], lambda v, n: (finished(v.reshape(-1, n)).ravel(),), "pixels array<double>")


def balance_images(images: DataFrame, keep: list[str], step: int = EVERY, sigma: float = 3.0, pixels: str = "pixels") -> DataFrame:
    """(keep, channel, coefficient): ``channel_balance`` of images of three interleaved channels."""
    made = map_frames(images, keep, [pixels], lambda v: (channel_balance(v.astype(float).reshape(-1, 3), step, sigma),), "c array<double>")
    return made.select(*keep, F.posexplode("c").alias("channel", "coefficient"))


def with_inner_bounds(transforms: DataFrame, keep: list[str], width: int, height: int) -> DataFrame:
    """(keep, x0, y0, x1, y1), ends exclusive: of every transform (a, b, tx, ty) a rectangle of the output in which every pixel of a moved frame comes from inside the
    frame; zeros if there is none.

    The frame's four corners are moved; of their coordinates the two middle ones of each axis bound the rectangle, which shrinks by a pixel
    on all sides, four times at most, until its corners are read from inside.
    """
    a, b, tx, ty = (F.col(c).cast("double") for c in ("a", "b", "tx", "ty"))
    corners = [(x, y) for x in (0, width - 1) for y in (0, height - 1)]
    xs = F.array_sort(F.array(*(a * x - b * y + tx for x, y in corners)))
    ys = F.array_sort(F.array(*(b * x + a * y + ty for x, y in corners)))

    def low(v: Column) -> Column:
        return F.greatest(F.ceil(v[1]).cast("int"), F.lit(0))

    def high(v: Column, size: int) -> Column:
        return F.least(F.floor(v[2]).cast("int") + 1, F.lit(size))

    moved = transforms.withColumn("_box", F.struct(low(xs).alias("x0"), low(ys).alias("y0"), high(xs, width).alias("x1"), high(ys, height).alias("y1")))
    scale = a * a + b * b

    def inside(x: Column, y: Column) -> Column:
        sx, sy = (a * (x - tx) + b * (y - ty)) / scale, (a * (y - ty) - b * (x - tx)) / scale
        return (sx >= 0) & (sy >= 0) & (F.ceil(sx) < width) & (F.ceil(sy) < height)

    tried = []
    for k in range(5):
        x0, y0, x1, y1 = F.col("_box.x0") + k, F.col("_box.y0") + k, F.col("_box.x1") - k, F.col("_box.y1") - k
        fits = (x1 > x0) & (y1 > y0) & inside(x0, y0) & inside(x1 - 1, y0) & inside(x0, y1 - 1) & inside(x1 - 1, y1 - 1)
        tried.append(F.when(fits, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))))
    none = F.struct(*(F.lit(0).alias(c) for c in ("x0", "y0", "x1", "y1")))
    return moved.withColumn("_box", F.coalesce(*tried, none)).select(*keep, "_box.*")


def star_overlay(stars: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, cx, cy, r): a circle of half its FWHM for every star of a plausible one."""
    return stars.where(F.col("fwhm").between(LEAST_FWHM, MOST_FWHM)).select(*keep, "cx", "cy", (F.col("fwhm") / 2).alias("r"))


def check_flat(flat: DataFrame, lights: DataFrame) -> DataFrame:
    """(field, flat, light): what keeps a flat (one image row) from dividing the lights: width, height, channels, colour space or mosaic pattern of the
    first light by path that differ. No row: it fits."""
    fields = {"width": F.col("width"), "height": F.col("height"), "channels": F.col("channels"), "color_space": F.col("color_space"), "pattern": F.when(F.col("color_space") == "Bayer", _pattern())}
    both = F.array(*(F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in fields.items()))
    first = lights.agg(F.min_by(both, "path").alias("f")).select(F.explode("f").alias("f")).select("f.field", F.col("f.value").alias("light"))
    own = flat.select(F.explode(both).alias("f")).select("f.field", F.col("f.value").alias("flat"))
    return own.join(first, "field").where(~F.col("flat").eqNullSafe(F.col("light"))).select("field", "flat", "light")
