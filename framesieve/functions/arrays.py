"""Pixels as arrays of doubles (row-major): column in, column out, on higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of red, green and blue in luminance; the factor from MAD to a standard deviation.
LUMA = (0.299, 0.587, 0.114)
MAD_SIGMA = 1.4826


def normalize(pixels: Column, depth: str) -> Column:
    """Samples as fractions: u8 by 255, u16 by 65535, f32 as they are."""
    scale = {"u8": 255.0, "u16": 65535.0, "f32": 1.0}[depth]
    return F.transform(pixels, lambda v: v.cast("double") / scale)


def rescale_f32(pixels: Column) -> Column:
    """Float samples that were written as whole numbers: by 65535 if one is above 255, by 255 if one is above 1.5."""
    top = F.array_max(pixels)
    return F.when(top > 255, F.transform(pixels, lambda v: v / 65535)).when(top > 1.5, F.transform(pixels, lambda v: v / 255)).otherwise(pixels)


def luminance(pixels: Column, channels: int) -> Column:
    """Interleaved samples to one value per pixel: weighted for 3 channels, the first channel for other counts above 1."""
    if channels == 1:
        return pixels
    count = F.floor(F.size(pixels) / channels).cast("int")

    def at(i: Column, c: int) -> Column:
        return F.element_at(pixels, (i * channels + c + 1).cast("int"))

    def value(i: Column) -> Column:
        return at(i, 0) * LUMA[0] + at(i, 1) * LUMA[1] + at(i, 2) * LUMA[2] if channels == 3 else at(i, 0)

    return F.transform(F.sequence(F.lit(0), count - 1), value)


def subsample(pixels: Column, step: int) -> Column:
    """Every ``step``-th element from the first on."""
    return F.filter(pixels, lambda v, i: i % step == 0)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0))


def median(values: Column) -> Column:
    """The middle value, or the mean of the middle two; null for an empty array."""
    n = F.size(values)
    return _let(F.array_sort(values), lambda s: F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2))


def median_upper(values: Column) -> Column:
    """The middle value, the upper of two; null for an empty array."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def population_sigma(values: Column) -> Column:
    squares = _let(mean(values), lambda m: F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)))
    return F.sqrt(squares / F.nullif(F.size(values), F.lit(0)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sigma_clip(values: Column, sigma: float = 3.0, rounds: int = 5) -> Column:
    """The values within ``sigma`` deviations (about the mean) of the median, clipped up to ``rounds`` times.

    Once a round takes nothing away the later ones do not either, so all rounds are run. A round that would leave nothing changes nothing.
    """

    def clip(kept: Column) -> Column:
        def inside(s: Column) -> Column:
            left = F.filter(kept, lambda v: (v >= s["m"] - sigma * s["d"]) & (v <= s["m"] + sigma * s["d"]))
            return F.when((s["d"] <= 0) | (F.size(left) == 0), kept).otherwise(left)

        return _let(F.struct(median(kept).alias("m"), population_sigma(kept).alias("d")), inside)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array_sort(values), lambda kept, _: clip(kept))


def background(values: Column, sigma: float = 3.0, rounds: int = 5) -> Column:
    """struct(median, sigma) of the clipped values."""
    return _let(sigma_clip(values, sigma, rounds), lambda kept: F.struct(median(kept).alias("median"), population_sigma(kept).alias("sigma")))


def array_bytes(values: Column, width: int = 4) -> Column:
    """What an array of samples of ``width`` bytes takes."""
    return F.size(values) * width


def clipped_fraction(values: Column, level: float = 0.995) -> Column:
    """The share of values at ``level`` or above, 0 for an empty array."""
    return F.coalesce(F.size(F.filter(values, lambda v: v >= level)) / F.nullif(F.size(values), F.lit(0)), F.lit(0.0))


def flat_divide(values: Column, flat: Column, floor: float = 0.1) -> Column:
    """values over a flat of mean 1, the flat held at ``floor`` or above; unchanged if lengths differ."""
    level = mean(flat)
    even = _let(level, lambda m: F.zip_with(values, flat, lambda v, f: v / F.greatest(f / m, F.lit(floor))))
    return F.when(F.size(values) == F.size(flat), even).otherwise(values)


def midtone(x: Column, m: Column) -> Column:
    """The midtone transfer curve: 0 and 1 stay, m goes to a half."""
    curve = (m - 1) * x / ((2 * m - 1) * x - m)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(m == 0.5, x).otherwise(curve)


def stretch_parameters(values: Column, clip: float = -2.8, target: float = 0.15) -> Column:
    """struct(shadow, midtone): where shadows are clipped, and the midtone that brings the median of the rest to ``target``."""

    def rest(c0: Column) -> Column:
        lifted = F.transform(F.filter(values, lambda v: v > c0), lambda v: (v - c0) / (1 - c0))
        middle = F.coalesce(median_upper(lifted), F.lit(0.0))
        return F.struct(c0.alias("shadow"), midtone(F.lit(target), middle).alias("midtone"))

    def shadow(m: Column) -> Column:
        mad = median_upper(F.transform(values, lambda v: F.abs(v - m)))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), m + clip * MAD_SIGMA * mad))

    return _let(_let(median_upper(values), shadow), rest)


def stretch(values: Column, parameters: Column) -> Column:
    """Values with shadows clipped and midtones lifted by the given parameters."""

    def lifted(s: Column) -> Column:
        return F.transform(values, lambda v: midtone(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - s["shadow"]) / (1 - s["shadow"]))), s["midtone"]))

    return _let(parameters, lifted)


def min_max(values: Column) -> Column:
    """Values between the least and the greatest finite one as 0 to 1; null without spread."""
    finite = F.filter(values, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    ends = F.struct(F.array_min(finite).alias("low"), F.array_max(finite).alias("high"))
    return _let(ends, lambda e: F.transform(values, lambda v: (v - e["low"]) / F.nullif(e["high"] - e["low"], F.lit(0.0))))


def to_byte(values: Column) -> Column:
    """Fractions as 0 to 255, cut off, not rounded."""
    return F.transform(values, lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255).cast("int"))


def nearest_rank(values: Column, percent: float) -> Column:
    """The value at place round(percent / 100 * (n - 1)) of the sorted array."""
    return F.get(F.array_sort(values), F.round((F.size(values) - 1) * (percent / 100)).cast("int"))


def percentile_stretch(values: Column, low: float = 0.1, high: float = 99.99) -> Column:
    """Values between two percentiles as 0 to 1."""

    def scaled(s: Column) -> Column:
        return F.transform(values, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - s["low"]) / F.greatest(s["high"] - s["low"], F.lit(1e-6)))))

    return _let(F.struct(nearest_rank(values, low).alias("low"), nearest_rank(values, high).alias("high")), scaled)


def planar_to_interleaved(planes: Column, channels: int) -> Column:
    """[channel][pixel] to [pixel][channel]."""
    count = F.floor(F.size(planes) / channels).cast("int")
    return F.transform(F.sequence(F.lit(0), F.size(planes) - 1), lambda i: F.element_at(planes, ((i % channels) * count + F.floor(i / channels) + 1).cast("int")))


def pixel_at(pixels: Column, x: int | Column, y: int | Column, width: int, channels: int = 1, channel: int = 0) -> Column:
    """One sample of an interleaved image; null outside."""
    index = (F.lit(y) if isinstance(y, int) else y) * width + x
    return F.get(pixels, (index * channels + channel).cast("int"))


def debayer(pixels: Column, width: int, height: int, pattern: str = "RGGB") -> Column:
    """array of struct(r, g, b): a colour mosaic interpolated bilinearly.

    A pixel's missing channels are means of the nearest samples of that channel: four diagonal or four
    adjacent ones, or two along the row or column. Beyond an edge the image is mirrored without
    repeating the edge. Values are held to 0..1.
    """

    def colour(x: Column, y: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, pattern)), ((y % 2) * 2 + x % 2 + 1).cast("int"))

    def mirrored(i: Column, n: int) -> Column:
        return F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)

    def pixel(i: Column) -> Column:
        x, y = (i % width).cast("int"), F.floor(i / width).cast("int")

        def at(dx: int, dy: int) -> Column:
            return F.element_at(pixels, (mirrored(y + dy, height) * width + mirrored(x + dx, width) + 1).cast("int"))

        own, beside = colour(x, y), colour(x + 1, y)
        row, column = (at(-1, 0) + at(1, 0)) / 2, (at(0, -1) + at(0, 1)) / 2
        corners, cross = (at(-1, -1) + at(1, -1) + at(-1, 1) + at(1, 1)) / 4, (at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1)) / 4

        def channel(name: str) -> Column:
            other = "B" if name == "R" else "R"
            value = F.when(own == name, at(0, 0)).when(own == other, corners).when(beside == name, row).otherwise(column)
            return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))

        green = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(own == "G", at(0, 0)).otherwise(cross)))
        return F.struct(channel("R").alias("r"), green.alias("g"), channel("B").alias("b"))

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)


def rgb_luminance(rgb: Column) -> Column:
    return F.transform(rgb, lambda p: p["r"] * LUMA[0] + p["g"] * LUMA[1] + p["b"] * LUMA[2])
