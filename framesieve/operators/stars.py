"""Stars in images: local maxima, shape from moments, and detection in whole frames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Full width at half maximum of a Gaussian, in standard deviations.
FWHM_PER_SIGMA = 2.355


@dataclass(frozen=True)
class Detection:
    """What makes a star; the defaults are fixed values.

    detect, flood: deviations above the background for a peak and for the area around it; radius: of the square in which a peak is highest; saturation: samples from
    which on a pixel is no peak; least_peak: over the background; least_pixels: of an area.
    """

    detect: float = 5.0
    flood: float = 2.0
    radius: int = 3
    saturation: float = 0.98
    least_peak: float = 0.009
    least_pixels: int = 5


DETECTION = Detection()
STAR_SCHEMA = "frame string, star_id int, cx double, cy double, peak double, x0 int, y0 int, x1 int, y1 int, pixel_count int, fwhm double, eccentricity double"


def moment_shapes(patches: DataFrame, keys: list[str], value: str = "w") -> DataFrame:
    """(keys, cx, cy, fwhm, eccentricity) from the intensity-weighted moments of each star's pixels of weight above 0.

    fwhm is null for a patch less than 2 pixels wide or high; eccentricity where the larger eigenvalue is not above 0
    or the smaller is below 0.
    """
    weighted = patches.where(F.col(value) > 0)
    w, x, y = F.col(value), F.col("x"), F.col("y")
    sums = weighted.groupBy(*keys).agg(F.sum(w).alias("m"), F.sum(w * x).alias("mx"), F.sum(w * y).alias("my"))
    centred = sums.select(*keys, "m", (F.col("mx") / F.col("m")).alias("cx"), (F.col("my") / F.col("m")).alias("cy"))
    dx, dy = x - F.col("cx"), y - F.col("cy")
    second = weighted.join(centred, keys).groupBy(*keys, "cx", "cy").agg(
        (F.sum(w * dx * dx) / F.max("m")).alias("xx"),
        (F.sum(w * dy * dy) / F.max("m")).alias("yy"),
        (F.sum(w * dx * dy) / F.max("m")).alias("xy"),
        (F.max("x") - F.min("x")).alias("wide"),
        (F.max("y") - F.min("y")).alias("high"),
    )
    half, turn = (F.col("xx") + F.col("yy")) / 2, F.sqrt(((F.col("xx") - F.col("yy")) / 2) * ((F.col("xx") - F.col("yy")) / 2) + F.col("xy") * F.col("xy"))
    large, small = half + turn, half - turn
    return second.select(*keys, "cx", "cy", F.when((F.col("wide") >= 1) & (F.col("high") >= 1), FWHM_PER_SIGMA * F.sqrt(half)).alias("fwhm"), F.when((large > 0) & (small >= 0), F.sqrt(1 - small / large)).alias("eccentricity"))


def frame_shapes(stars: DataFrame, by: str) -> DataFrame:
    """(by, detected_stars, star_count, fwhm, eccentricity): medians over a frame's stars; a FWHM counts between 0.5 and 50."""
    valid = (F.col("fwhm") > 0.5) & (F.col("fwhm") < 50)
    return stars.groupBy(by).agg(
        F.count("*").alias("detected_stars"),
        F.count(F.when(valid, 1)).alias("star_count"),
        F.median(F.when(valid, F.col("fwhm"))).alias("fwhm"),
        F.median("eccentricity").alias("eccentricity"),
    )


def brightest(stars: DataFrame, by: str, count: int = 30) -> DataFrame:
    """The ``count`` stars of highest peak of every frame."""
    order = W.partitionBy(by).orderBy(F.col("peak").desc(), "star_id")
    return stars.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= count).drop("_place")


def heat_grid(stars: DataFrame, by: str, width: float, height: float, grid: int) -> DataFrame:
    """(by, gx, gy, fwhm): mean FWHM of the stars in every cell of a grid; an empty cell has the frame's mean."""
    def cell(c: str, size: float):
        return F.least(F.floor(F.col(c) / (size / grid)), F.lit(grid - 1)).cast("int")

    placed = stars.select(by, cell("cx", width).alias("gx"), cell("cy", height).alias("gy"), "fwhm")
    means = placed.groupBy(by, "gx", "gy").agg(F.avg("fwhm").alias("cell"))
    every = stars.groupBy(by).agg(F.avg("fwhm").alias("whole"))
    cells = every.withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    return cells.join(means, [by, "gx", "gy"], "left").select(by, "gx", "gy", F.coalesce("cell", "whole").alias("fwhm"))


#: Stars that a heat map needs, stars below which it is uncertain, and how many cells a side it has from so many stars on.
LEAST_STARS, FEW_STARS = 25, 75
GRIDS = ((400, 7), (900, 9), (1600, 11), (2500, 13), (3600, 15))


def heat_map(stars: DataFrame, by: str, width: float, height: float, levels: int = 10) -> DataFrame:
    """(by, grid, gx, gy, fwhm, few, level): a heat grid whose side follows the number of stars; frames of fewer than LEAST_STARS have none.

    few: fewer than FEW_STARS. level: how many of ``levels`` contour lines, evenly spaced between the frame's least and greatest cell (0.01 apart at
    least), lie at or below the cell.
    """
    counted = stars.groupBy(by).agg(F.count("*").alias("n"), F.avg("fwhm").alias("whole")).where(F.col("n") >= LEAST_STARS)
    grid = F.lit(5)
    for least, side in GRIDS:
        grid = F.when(F.col("n") >= least, side).otherwise(grid)
    sized = counted.withColumn("grid", grid)

    def cell(c: str, size: float):
        return F.least(F.floor(F.col(c) / (size / F.col("grid"))), F.col("grid") - 1).cast("int")

    placed = stars.join(sized.select(by, "grid"), by).select(by, cell("cx", width).alias("gx"), cell("cy", height).alias("gy"), "fwhm")
    means = placed.groupBy(by, "gx", "gy").agg(F.avg("fwhm").alias("cell"))
    side = F.sequence(F.lit(0), F.col("grid") - 1)
    cells = sized.withColumn("gx", F.explode(side)).withColumn("gy", F.explode(side)).join(means, [by, "gx", "gy"], "left").withColumn("fwhm", F.coalesce("cell", "whole"))
    ends = cells.groupBy(by).agg(F.min("fwhm").alias("low"), F.max("fwhm").alias("high"))
    span = F.greatest(F.col("high") - F.col("low"), F.lit(0.01))
    line = F.floor((F.col("fwhm") - F.col("low")) / (span / (levels + 1)))
    return cells.join(ends, by).select(by, "grid", "gx", "gy", "fwhm", (F.col("n") < FEW_STARS).alias("few"), F.least(line, F.lit(levels)).cast("int").alias("level"))


def clipped_background(values: np.ndarray, sigma: float = 3.0, rounds: int = 5) -> tuple[float, float]:
    """(median, deviation) of sigma-clipped values; sorted once, so what a round keeps is a slice."""
    kept = np.sort(values)
    for _ in range(rounds):
        middle, spread = _middle(kept), kept.std()
        near = np.abs(kept - middle) <= sigma * spread
        low, high = int(near.argmax()), len(near) - int(near[::-1].argmax())
        if spread <= 0 or not near.any() or high - low == len(kept):
            break
        kept = kept[low:high]
    return float(_middle(kept)), float(kept.std())


def _middle(ordered: np.ndarray) -> float:
    """The median of sorted values; nan if one is nan."""
    half = len(ordered) // 2
    return ordered[-1] if np.isnan(ordered[-1]) else ordered[half] if len(ordered) % 2 else (ordered[half - 1] + ordered[half]) / 2


def labelled_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, area) of the runs of set pixels in the rows of ``mask``, as places in the flat image; runs of a 4-connected area have the number of its first run.

    Runs of neighbouring rows that share a column are joined; joined runs take the least number they reach, halving the way to it in each round.
    """
    h, w = mask.shape
    edge = np.zeros((h, w + 1), bool)
    edge[:, 0], edge[:, w] = mask[:, 0], mask[:, w - 1]
    np.not_equal(mask[:, 1:], mask[:, :-1], out=edge[:, 1:w])
    at = np.flatnonzero(edge)
    row, column = np.divmod(at, w + 1)
    at = row * w + column
    start, end = at[::2], at[1::2]
    first, last = np.searchsorted(end, start + w, "right"), np.searchsorted(start, end + w)
    n = last - first
    upper = np.repeat(np.arange(len(start)), n)
    lower = np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    area = np.arange(len(start))
    while len(upper):
        low = np.minimum(area[upper], area[lower])
        np.minimum.at(area, area[upper], low)
        np.minimum.at(area, area[lower], low)
        while True:
            root = area[area]
            if (root == area).all():
                break
            area = root
        apart = area[upper] != area[lower]
        upper, lower = upper[apart], lower[apart]
    return start, end, area


def _peaks(image: np.ndarray, least: float, given: Detection) -> np.ndarray:
    """Flat places, ascending, of pixels of at least ``least`` below saturation that are above all others in their square; none near the edges."""
    h, w = image.shape
    r = given.radius
    if h <= 2 * r or w <= 2 * r:
        return np.zeros(0, np.int64)
    inner = image[r : h - r, r : w - r]
    y, x = np.divmod(np.flatnonzero((inner >= least) & (inner < given.saturation)), w - 2 * r)
    at, flat = (y + r) * w + x + r, image.ravel()
    around = [(j, i) for j in range(-r, r + 1) for i in range(-r, r + 1) if (j, i) != (0, 0)]
    for j, i in sorted(around, key=lambda p: p[0] ** 2 + p[1] ** 2):  # near ones first: few candidates are left after them
        at = at[flat[at] > flat[at + j * w + i]]
    return at


def star_table(image: np.ndarray, given: Detection = DETECTION) -> pd.DataFrame:
    """Stars of one image, brightest first: the columns of STAR_SCHEMA but the frame.

    Areas are labelled once, as runs; all sums over areas are reductions of one sorted list of the pixels of areas that hold a peak.
    """
    w = image.shape[1]
    level, spread = clipped_background(image.ravel()[::4])
    spread = max(spread, 1e-6)
    peaks = _peaks(image, level + given.detect * spread, given)
    start, end, area = labelled_runs(np.maximum(image - level, 0) >= given.flood * spread)
    run = np.searchsorted(start, peaks, "right") - 1
    held = (run >= 0) & (peaks < end[run]) if len(start) else np.zeros(len(peaks), bool)
    owner, first = np.unique(area[run[held]], return_index=True)  # an area is its first peak's
    peak = np.maximum(image.ravel()[peaks[held][first]] - level, 0)
    own = np.flatnonzero(np.isin(area, owner))
    own = own[np.argsort(area[own], kind="stable")]
    size = (end - start)[own]
    pixel = np.repeat(start[own] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
    edges = np.searchsorted(np.repeat(area[own], size), owner)
    rows, columns = np.divmod(pixel, w)
    count = np.diff(np.append(edges, len(pixel)))

    def total(v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, edges) if len(edges) else np.zeros(0)

    weight = np.maximum(image.ravel()[pixel] - level, 0)
    mass = total(weight)
    cx, cy = total(weight * columns) / mass, total(weight * rows) / mass
    dx, dy = columns - np.repeat(cx, count), rows - np.repeat(cy, count)
    xx, yy, xy = total(weight * dx**2) / mass, total(weight * dy**2) / mass, total(weight * dx * dy) / mass
    bounds = [f.reduceat(v, edges) if len(edges) else np.zeros(0, np.int64) for f, v in ((np.minimum, columns), (np.minimum, rows), (np.maximum, columns), (np.maximum, rows))]
    turn = np.hypot((xx - yy) / 2, xy)
    large, small = (xx + yy) / 2 + turn, (xx + yy) / 2 - turn
    wide = (bounds[2] > bounds[0]) & (bounds[3] > bounds[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        fwhm, eccentricity = np.where(wide, FWHM_PER_SIGMA * np.sqrt((xx + yy) / 2), np.nan), np.where((large > 0) & (small >= 0), np.sqrt(1 - small / large), np.nan)
    stars = pd.DataFrame(dict(zip(["cx", "cy", "peak", "x0", "y0", "x1", "y1", "pixel_count", "fwhm", "eccentricity"], [cx, cy, peak, *bounds, count, fwhm, eccentricity], strict=True)))
    stars = stars.iloc[np.argsort(first)]  # in the order of their first peaks
    stars = stars[(stars.pixel_count >= given.least_pixels) & (stars.peak >= given.least_peak)]
    if len(stars) >= 2:
        size = np.sort(stars.pixel_count)[len(stars) // 2]
        stars = stars[~((stars.pixel_count > 5 * size) & (stars.peak < 0.1 * stars.peak.max()))]
    stars = stars.sort_values("peak", ascending=False, kind="stable").reset_index(drop=True)
    stars.insert(0, "star_id", stars.index)
    return stars


def detect_stars(frames: DataFrame, given: Detection = DETECTION) -> DataFrame:
    """Stars of frames (frame, width, height, luma array<double>): STAR_SCHEMA, brightest first; fwhm and eccentricity are null where a star has none.

    A star is an area of pixels above the clipped background that holds a strict local maximum: not
    saturated, bright enough, of enough pixels; wide faint areas are left out. A frame is one row, so
    frames are the unit of work.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame, width, height, luma in zip(batch["frame"], batch["width"], batch["height"], batch["luma"], strict=True):
                stars = star_table(np.asarray(luma, float).reshape(height, width), given)
                stars.insert(0, "frame", frame)
                yield stars

    return frames.select(F.col("frame").cast("string"), "width", "height", "luma").mapInPandas(found, STAR_SCHEMA)


#: Fixed values of a star's profile: its exponent, most steps, first damping, least step, bounds of its half axes, least ratio of them, largest residual over the amplitude.
EXPONENT, STEPS, DAMPING, LEAST_STEP, LEAST_AXIS, MOST_AXIS, LEAST_RATIO, MOST_RESIDUAL = 4.765, 50, 1e-3, 1e-5, 0.5, 30.0, 0.2, 0.3
PROFILE_SCHEMA = "frame string, star_id int, amplitude double, cx double, cy double, major double, minor double, residual double, signal_weight double"


def fit_profile(patch: np.ndarray, cx: float, cy: float) -> tuple[float, ...] | None:
    """(amplitude, cx, cy, major, minor, residual, signal weight) of a star, or None where no sound profile fits.

    patch: samples over the background; cx, cy: where the star is in it. The profile is
    amplitude * (1 + ((x - cx) / a)^2 + ((y - cy) / b)^2)^-EXPONENT over the mean of the patch's border, fitted by damped least squares.
    The signal weight is amplitude^2 / (amplitude + border * pi * a * b).
    """
    high, wide = patch.shape
    if min(high, wide) < 3:
        return None
    y, x = (v.ravel() for v in np.mgrid[:high, :wide])
    rim = (x == 0) | (y == 0) | (x == wide - 1) | (y == high - 1)
    values = patch.ravel().astype(float)
    border = values[rim].mean()
    axis = min(max(min(high, wide) / 4, LEAST_AXIS), MOST_AXIS)

    def off(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the profile misses, and its slope by each parameter."""
        dx, dy = (x - p[1]) / p[3], (y - p[2]) / p[4]
        base = 1 + dx * dx + dy * dy
        shape = base**-EXPONENT
        steep = 2 * EXPONENT * p[0] * shape / base
        slopes = np.stack([shape, steep * dx / p[3], steep * dy / p[4], steep * dx * dx / p[3], steep * dy * dy / p[4]])
        return values - border - p[0] * shape, slopes

    best = np.array([max(values.max() - border, 1e-6), cx, cy, axis, axis])
    missed, slopes = off(best)
    damping = DAMPING
    for _ in range(STEPS):
        normal = slopes @ slopes.T
        step = np.linalg.lstsq(normal + damping * np.diag(np.diag(normal)), slopes @ missed, rcond=None)[0]
        tried = best + step
        tried[0], tried[3:] = max(tried[0], 1e-6), np.clip(tried[3:], LEAST_AXIS, MOST_AXIS)
        now = off(tried)
        if (now[0] ** 2).sum() < (missed**2).sum():
            best, (missed, slopes), damping = tried, now, damping / 10
            if np.linalg.norm(step) < LEAST_STEP:
                break
        else:
            damping *= 10
            if damping > 1e8:
                break  # no step is better: best is a minimum
    minor, major = sorted(best[3:])
    left = float(np.sqrt((missed**2).mean()) / best[0])
    if minor / major < LEAST_RATIO or not left <= MOST_RESIDUAL:
        return None
    return *(float(v) for v in (*best[:3], major, minor)), left, float(best[0] ** 2 / (best[0] + border * np.pi * major * minor))


def star_profiles(frames: DataFrame, given: Detection = DETECTION) -> DataFrame:
    """Profiles of the stars of frames (frame, width, height, luma array<double>): PROFILE_SCHEMA; stars as ``detect_stars`` finds and numbers them.

    A star that no sound profile fits has no row.
    """

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for frame, width, height, luma in zip(batch["frame"], batch["width"], batch["height"], batch["luma"], strict=True):
                image = np.asarray(luma, float).reshape(height, width)
                above = np.maximum(image - clipped_background(image.ravel()[::4])[0], 0)
                for s in star_table(image, given).itertuples():
                    found = fit_profile(above[s.y0 : s.y1 + 1, s.x0 : s.x1 + 1], s.cx - s.x0, s.cy - s.y0)
                    if found:
                        rows.append((frame, s.star_id, found[0], found[1] + s.x0, found[2] + s.y0, *found[3:]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PROFILE_SCHEMA.split(", ")])

    return frames.select(F.col("frame").cast("string"), "width", "height", "luma").mapInPandas(fitted, PROFILE_SCHEMA)
