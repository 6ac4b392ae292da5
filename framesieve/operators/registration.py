"""Registration of frame pairs: phase correlation, one-to-one star matches, robust transforms; and a whole stack.

A pair of frames is one row or one small group, so pairs are the unit of work and any number of them is one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framesieve.functions.geometry import compose, transform
from framesieve.functions.keywords import same_filter
from framesieve.operators.frames import map_frames, resample_frames, with_inner_bounds
from framesieve.operators.matching import LEAST_SIDE, RATIO_TOLERANCE, VOTE_ANGLE, VOTE_SHIFT
from framesieve.operators.stacking import over_background, overlap
from framesieve.operators.stars import clipped_background
from framesieve.operators.tables import materialised
from framesieve.operators.tiles import CLIP, combine_tiles, cut_tiles, pixel_rows, tile_pixels

#: Longest side of the images that are correlated; radius, least matches, inlier distance, least inliers, trials, largest turn and shift.
LONGEST_SIDE = 1024
MATCH_RADIUS, LEAST_MATCHES, INLIER, LEAST_INLIERS, TRIALS, MOST_TURN, MOST_SHIFT = 15.0, 8, 2.0, 6, 50, 0.0349, 20.0
#: The linear congruential generator that picks trial pairs.
SEED, TIMES, PLUS = 0x12345678, 6364136223846793005, 1442695040888963407

#: Brightest stars that make triangles, distance and number of inliers of a triangle match; distance, least stars and largest mean residual
#: at which a group's transform is believed.
TRIANGLE_STARS, TRIANGLE_INLIER, TRIANGLE_INLIERS, VERIFY_RADIUS, VERIFY_STARS, VERIFY_RESIDUAL = 30, 3.0, 6, 10.0, 10, 2.0


def _reduced(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of blocks, non-finite samples left out."""
    if image.shape == (height, width):
        return image
    rows = (np.arange(height + 1) * (image.shape[0] / height)).astype(int)
    columns = (np.arange(width + 1) * (image.shape[1] / width)).astype(int)
    good = np.isfinite(image)
    total = np.add.reduceat(np.add.reduceat(np.where(good, image, 0.0), rows[:-1], axis=0), columns[:-1], axis=1)
    count = np.add.reduceat(np.add.reduceat(good.astype(float), rows[:-1], axis=0), columns[:-1], axis=1)
    return np.where(count > 0, total / np.maximum(count, 1), 0.0)


def _vertex(before: float, at: float, after: float) -> float:
    bend = 2 * at - before - after
    return (before - after) / (2 * bend) if abs(bend) > 1e-10 else 0.0


def _scaled(height: int, width: int) -> tuple[float, int, int]:
    """(scale, height, width) of what is correlated of an image."""
    scale = min(1.0, LONGEST_SIDE / max(height, width))
    return scale, max(1, round(height * scale)), max(1, round(width * scale))


def correlate(reference: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """(dx, dy) of the target against the reference from the peak of their phase correlation under a Hann window; of equal peaks the last."""
    scale, height, width = _scaled(*reference.shape)
    return correlate_reduced(_reduced(reference, height, width), _reduced(target, height, width), scale)


def correlate_reduced(reference: np.ndarray, target: np.ndarray, scale: float) -> tuple[float, float]:
    """``correlate`` of images that are reduced by ``scale`` already."""
    height, width = reference.shape
    window = np.outer(np.hanning(height), np.hanning(width))
    a, b = (np.fft.rfft2(x * window) for x in (reference, target))
    cross = a * b.conj()
    size = np.abs(cross)
    surface = np.fft.irfft2(np.where(size > 1e-10, cross / np.where(size > 1e-10, size, 1), 0), s=(height, width))
    y, x = divmod(surface.size - 1 - int(np.argmax(surface.ravel()[::-1])), width)
    dx = x + (_vertex(*surface[y, x - 1 : x + 2]) if 0 < x < width - 1 else 0.0)
    dy = y + (_vertex(*surface[y - 1 : y + 2, x]) if 0 < y < height - 1 else 0.0)
    dx, dy = (dx - width if dx > width // 2 else dx), (dy - height if dy > height // 2 else dy)
    return -dx / scale, -dy / scale


def phase_shift(pairs: DataFrame, key: str) -> DataFrame:
    """(key, dx, dy) for rows of key, width, height, reference and target (arrays of samples of one size)."""

    def shifted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *correlate(np.asarray(r, float).reshape(h, w), np.asarray(t, float).reshape(h, w))) for k, w, h, r, t in zip(batch["key"], batch["width"], batch["height"], batch["reference"], batch["target"], strict=True)]
            yield pd.DataFrame(rows, columns=["key", "dx", "dy"])

    given = pairs.select(F.col(key).cast("long").alias("key"), "width", "height", "reference", "target")
    return given.mapInPandas(shifted, "key long, dx double, dy double").withColumnRenamed("key", key)


def pick_one_to_one(stars: np.ndarray, references: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """(star, reference) rows: each star in turn takes the nearest free reference within ``radius``."""
    free, pairs = np.ones(len(references), bool), []
    for i, star in enumerate(stars):
        distance = np.where(free, np.hypot(*(references - star).T), np.inf)
        if len(distance) and distance.min() <= radius:
            j = int(distance.argmin())
            free[j] = False
            pairs.append((i, j))
    return pairs


def fit_similarity(f: np.ndarray, r: np.ndarray) -> tuple[float, float, float, float] | None:
    """(a, b, tx, ty) that takes f to r by least squares."""
    fc, rc = f - f.mean(axis=0), r - r.mean(axis=0)
    spread = (fc**2).sum()
    if len(f) < 2 or spread < 1e-10:
        return None
    a = (fc * rc).sum() / spread
    b = (fc[:, 0] * rc[:, 1] - fc[:, 1] * rc[:, 0]).sum() / spread
    (mx, my), (nx, ny) = f.mean(axis=0), r.mean(axis=0)
    return a, b, nx - a * mx + b * my, ny - b * mx - a * my


def robust_similarity(stars: np.ndarray, references: np.ndarray, dx: float, dy: float) -> tuple[float, float, float, float, int] | None:
    """(a, b, tx, ty, inliers) from one-to-one matches after a shift, or None.

    Two matches at a time give a transform; the trial with most inliers, the first of equal ones, is refined on
    them. A large turn, shift or too few inliers give None. The result takes unshifted stars to references.
    """
    moved = stars - (dx, dy)
    pairs = np.array(pick_one_to_one(moved, references, MATCH_RADIUS), int).reshape(-1, 2)
    n = len(pairs)
    if n < LEAST_MATCHES:
        return None
    f, r = moved[pairs[:, 0]], references[pairs[:, 1]]
    state, best = SEED, np.zeros(n, bool)

    def drawn() -> int:
        nonlocal state
        state = (state * TIMES + PLUS) % (1 << 64)
        return state >> 33

    for _ in range(TRIALS):
        i = drawn() % n
        j = (i + 1 + drawn() % (n - 1)) % n
        if ((f[i] - f[j]) ** 2).sum() < 100:
            continue
        a, b, tx, ty = fit_similarity(f[[i, j]], r[[i, j]])
        if abs(a * a + b * b - 1) > 0.05:
            continue
        reached = np.stack([a * f[:, 0] - b * f[:, 1] + tx, b * f[:, 0] + a * f[:, 1] + ty], axis=1)
        near = np.hypot(*(reached - r).T) <= INLIER
        if near.sum() > best.sum():
            best = near
    fitted = fit_similarity(f[best], r[best]) if best.sum() >= LEAST_INLIERS else None
    if fitted is None:
        return None
    a, b, tx, ty = fitted
    if abs(np.arctan2(b, a)) > MOST_TURN or max(abs(tx), abs(ty)) > MOST_SHIFT:
        return None
    return a, b, tx - (a * dx - b * dy), ty - (b * dx + a * dy), int(best.sum())


@cache
def _triples(n: int) -> np.ndarray:
    return np.array(list(combinations(range(n), 3)), int).reshape(-1, 3)


def _corners(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All triangles with sides of LEAST_SIDE or more: corners (their opposite sides descending), the two lesser sides over the greatest, and handedness."""
    corners = _triples(len(points))
    at = points[corners]
    opposite = np.abs((at[:, [1, 2, 0]] - at[:, [2, 0, 1]]) @ [1, 1j])
    order = np.argsort(-opposite, axis=1, kind="stable")
    corners, side = np.take_along_axis(corners, order, 1), np.take_along_axis(opposite, order, 1)
    wide = side[:, 2] >= LEAST_SIDE
    corners, side = corners[wide], side[wide]
    p, q, r = points[corners].transpose(1, 0, 2)
    hand = (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0]) >= 0
    return corners, side[:, 1:] / side[:, :1], hand


def triangle_similarity(stars: np.ndarray, references: np.ndarray) -> tuple[float, float, float, float, int] | None:
    """(a, b, tx, ty, inliers) by triangles of the first TRIANGLE_STARS stars of each, brightest first, or None. Any turn and shift is found.

    Triangles of equal handedness and like side ratios give a transform each, by the ends of their longest sides; ends nearer than 10 pixels and
    scales off by more than 5 % (squared) are left out. Transforms vote by shift and turn; the mean of the fullest bin, the least of equal
    ones, picks the matches that the result is fitted to.
    """
    (own, ratios, hand), (theirs, wanted, other) = (_corners(p[:TRIANGLE_STARS]) for p in (stars, references))
    order = np.argsort(wanted[:, 0], kind="stable")
    theirs, wanted, other = theirs[order], wanted[order], other[order]
    low = np.searchsorted(wanted[:, 0], ratios[:, 0] - RATIO_TOLERANCE)
    count = np.searchsorted(wanted[:, 0], ratios[:, 0] + RATIO_TOLERANCE, "right") - low
    i = np.repeat(np.arange(len(own)), count)
    j = np.arange(len(i)) + np.repeat(low - np.cumsum(count) + count, count)
    alike = (hand[i] == other[j]) & (((ratios[i] - wanted[j]) ** 2).sum(axis=1) <= RATIO_TOLERANCE**2)
    f, r = (points[corners[at[alike], 1:]] @ [1, 1j] for points, corners, at in ((stars, own, i), (references, theirs, j)))
    far = np.abs(f[:, 0] - f[:, 1]) >= 10
    f, r = f[far], r[far]
    turn = (r[:, 0] - r[:, 1]) / (f[:, 0] - f[:, 1])
    rigid = np.abs(np.abs(turn) ** 2 - 1) <= 0.05
    turn, shift = turn[rigid], (r[:, 0] - turn * f[:, 0])[rigid]
    if not len(turn):
        return None
    bins = np.stack([shift.real / VOTE_SHIFT, shift.imag / VOTE_SHIFT, np.angle(turn) / VOTE_ANGLE], axis=1)
    bins = np.trunc(bins + np.copysign(0.5, bins))
    _, place, votes = np.unique(bins, axis=0, return_inverse=True, return_counts=True)
    chosen = place.ravel() == votes.argmax()
    turn, shift = turn[chosen].mean(), shift[chosen].mean()
    moved = stars @ [1, 1j] * turn + shift
    pairs = np.array(pick_one_to_one(np.stack([moved.real, moved.imag], axis=1), references, TRIANGLE_INLIER), int).reshape(-1, 2)
    if len(pairs) < TRIANGLE_INLIERS:
        return None
    fitted = fit_similarity(stars[pairs[:, 0]], references[pairs[:, 1]]) or (turn.real, turn.imag, shift.real, shift.imag)
    return *map(float, fitted), len(pairs)


def residual(stars: np.ndarray, references: np.ndarray, a: float, b: float, tx: float, ty: float) -> tuple[int, float | None]:
    """(stars that come nearer than VERIFY_RADIUS to a reference, their mean distance)."""
    if not len(stars) or not len(references):
        return 0, None
    moved = stars @ [1, 1j] * (a + 1j * b) + (tx + 1j * ty)
    there = references @ [1, 1j]
    distance = np.concatenate([np.abs(moved[k : k + 256, None] - there).min(axis=1) for k in range(0, len(moved), 256)])
    near = distance[distance < VERIFY_RADIUS]
    return len(near), float(near.mean()) if len(near) else None


def one_to_one(stars: DataFrame, references: DataFrame, by: str, radius: float = MATCH_RADIUS) -> DataFrame:
    """(by, star_id, ref_id): stars in the order of star_id take the nearest free reference. A group holds the stars of one pair of frames."""

    def matched(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("star_id"), right.sort_values("star_id")
        pairs = pick_one_to_one(left[["x", "y"]].to_numpy(float), right[["x", "y"]].to_numpy(float), radius)
        return pd.DataFrame([(key[0], left["star_id"].iloc[i], right["star_id"].iloc[j]) for i, j in pairs], columns=[by, "star_id", "ref_id"])

    return stars.groupBy(by).cogroup(references.groupBy(by)).applyInPandas(matched, f"{by} long, star_id long, ref_id long")


def estimate_transforms(stars: DataFrame, references: DataFrame, shifts: DataFrame, by: str) -> DataFrame:
    """(by, a, b, tx, ty, inliers) of every pair of frames that can be registered; shifts: by, dx, dy (a missing one is 0)."""
    moved = stars.join(shifts.select(by, "dx", "dy"), by, "left").fillna(0.0, ["dx", "dy"])
    return _solve_pairs(moved, references, by, robust_similarity, "a double, b double, tx double, ty double, inliers int", ["dx", "dy"])


def _solve_pairs(stars: DataFrame, references: DataFrame, by: str, solve: Callable[..., tuple | None], added: str, also: list[str] | None = None) -> DataFrame:
    """(by, added): what ``solve`` finds from the places of the stars of each pair of frames, in the order of star_id, and the columns ``also`` of the first frame; pairs without stars
    on a side, or for which it finds nothing, have no row.

    A pair is one row of two arrays, so a batch holds many pairs. Both sides are dealt into as many parts as shuffles have: small as their rows are, they are dear to solve.
    """
    also = also or []
    parts = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c.split()[0] for c in added.split(", ")]

    def gathered(df: DataFrame, side: str, more: list[str]) -> DataFrame:
        place = F.struct("star_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        rows = df.repartition(parts, by).groupBy(by).agg(F.array_sort(F.collect_list(place)).alias("_s"), *(F.first(c).alias(c) for c in more))
        return rows.select(by, *(F.col(f"_s.{c}").alias(f"_{side}{c}") for c in "xy"), *more)

    def solved(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray, *more) -> tuple:
        return solve(np.stack([lx, ly], axis=1), np.stack([rx, ry], axis=1), *more) or (None,) * len(names)

    pairs = gathered(stars, "l", also).join(gathered(references, "r", []).hint("merge"), by).withColumn(by, F.col(by).cast("long"))
    found = map_frames(pairs, [by], ["_lx", "_ly", "_rx", "_ry", *also], solved, added)
    return found.where(F.col(names[0]).isNotNull())


def triangle_transforms(stars: DataFrame, references: DataFrame, by: str) -> DataFrame:
    """(by, a, b, tx, ty, inliers) of every pair of frames that triangles register; star_id counts from the brightest star, as ``detect_stars`` does."""
    return _solve_pairs(stars, references, by, triangle_similarity, "a double, b double, tx double, ty double, inliers int")


def matched_turns(frames: DataFrame, stars: DataFrame, by: str, key: str, observed: str, rotator: str) -> DataFrame:
    """(by, key, matched_turn): degrees by which a frame is turned against the one before it, by their stars, where either rotator angle is unknown.

    stars: by, key, star_id, x, y. A frame that cannot be matched has no row. Give ``matched_turn`` to ``assign_groups``.
    """
    order = W.partitionBy(by).orderBy(F.col(observed).asc_nulls_first(), key)
    places = frames.select(by, key, rotator, F.lag(key).over(order).alias("_before"), F.lag(rotator).over(order).alias("_angle"))
    unknown = places.where(F.col("_before").isNotNull() & (F.col(rotator).isNull() | F.col("_angle").isNull()))
    pairs = unknown.select(by, key, "_before").withColumn("pair", F.xxhash64(by, key))
    left = pairs.join(stars, [by, key]).select("pair", "star_id", "x", "y").toDF("pair", "star_id", "x", "y")
    right = pairs.select(by, "pair", F.col("_before").alias(key)).join(stars, [by, key]).select("pair", "star_id", "x", "y").toDF("pair", "star_id", "x", "y")
    found = triangle_transforms(left, right, "pair")
    return pairs.join(found, "pair").select(by, key, F.abs(F.degrees(F.atan2("b", "a"))).alias("matched_turn"))


#: Bytes of all reduced references up to which they are broadcast; parts into which a group's frames are dealt beyond.
BROADCAST_BYTES, SALTS = 64 << 20, 16
#: Fixed value: turns from which a frame is read through its transform; below, it is only shifted.
LEAST_TURN = 0.001


def contributions(frames: DataFrame, references: DataFrame, by: str, key: str, width: int, height: int, stars: DataFrame | None = None) -> DataFrame:
    """(by, key, included, exclusion_reason, background_level, a, b, tx, ty): how each frame enters its group's stack.

    frames: by, key, filter, pixels (luminance of one size); references: one key per group and, where it is not the reference's own, the
    ``wanted_filter``. A frame of another filter is out (FilterMismatch; the reference never is, an unknown filter matches). The others are correlated
    with the reference. With ``stars`` (by, key, star_id, x, y) they are turned and shifted by the transform of their matched stars, and a frame whose
    stars do not confirm one is out (AlignmentFailed); without, they are only shifted.

    One map reduces every frame to its background and an image of LONGEST_SIDE pixels a side at most; only these meet the references', which are broadcast where all of
    them take BROADCAST_BYTES at most (one a group, of known size), and else dealt by group and salt, so that a large group is not one task's.
    """
    own = references.select(by, F.col(key).alias("reference"), *(["wanted_filter"] if "wanted_filter" in references.columns else []))
    scale, high, wide = _scaled(height, width)

    def reduced(v: np.ndarray | None) -> tuple:
        if v is None:
            return None, None
        image = v.astype(float)
        return clipped_background(image[::8])[0], _reduced(image.reshape(height, width), high, wide).ravel()

    small = map_frames(frames, [by, key, "filter"], ["pixels"], reduced, "background_level double, target array<double>")
    first = frames.select(by, key, "filter", "pixels").join(own, by).where(F.col(key) == F.col("reference"))
    wanted = F.col("wanted_filter" if "wanted_filter" in own.columns else "filter").alias("wanted")
    base = map_frames(first.withColumn("wanted", wanted), [by, "reference", "wanted"], ["pixels"], lambda v: (reduced(v)[1],), "base array<double>")
    if references.count() * high * wide * 8 <= BROADCAST_BYTES:
        paired = small.join(F.broadcast(base), by)
    else:
        salted = base.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        paired = small.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, [by, "_salt"])

    def measured(target: np.ndarray | None, base: np.ndarray | None) -> tuple:
        if target is None or base is None:
            return None, None
        return correlate_reduced(base.reshape(high, wide), target.reshape(high, wide), scale)

    same = same_filter(F.col("wanted"), F.col("filter")) | (F.col(key) == F.col("reference"))
    marked = map_frames(paired.withColumn("in", same), [by, key, "in", "reference", "background_level"], ["target", "base"], measured, "dx double, dy double")
    if stars is not None:
        marked = materialised(marked)
        theirs = stars.join(own, by).where(F.col(key) == F.col("reference"))
        pairs = marked.select(by, key, "dx", "dy").withColumn("pair", F.xxhash64(by, key))
        left = stars.join(pairs, [by, key]).select("pair", "star_id", "x", "y")
        right = theirs.select(by, "star_id", "x", "y").join(pairs.select(by, "pair"), by).select("pair", "star_id", "x", "y")
        left, right = (df.toDF("pair", "star_id", "x", "y") for df in (left, right))  # columns of their own, for the grouping of both
        found = estimate_transforms(left, right, pairs.select("pair", "dx", "dy"), "pair")
        marked = marked.join(pairs.select(by, key, "pair").join(found, "pair").select(by, key, "a", "b", "tx", "ty"), [by, key], "left")
    else:
        marked = marked.withColumns({"a": F.lit(1.0), "b": F.lit(0.0), "tx": -F.col("dx"), "ty": -F.col("dy")})
    still = F.col(key) == F.col("reference")
    reason = F.when(~F.col("in"), "FilterMismatch").when(F.col("background_level").isNull() | (~still & (F.col("a").isNull() | F.col("tx").isNull())), "AlignmentFailed")
    return marked.select(
        by, key, reason.isNull().alias("included"), reason.alias("exclusion_reason"), "background_level", *(F.when(still, 1.0 if c == "a" else 0.0).otherwise(F.col(c)).alias(c) for c in ("a", "b", "tx", "ty"))
    )


def cross_transforms(frames: DataFrame, stars: DataFrame, references: DataFrame, masters: DataFrame, by: str, group: str, key: str, width: int, height: int) -> DataFrame:
    """(by, group, a, b, tx, ty, matched, mean_residual, solved): each group's transform onto its session's master group.

    frames: group, key, pixels; stars: group, key, star_id, x, y; references: by, group, key (one frame a group); masters: by, group; ids of groups
    are unlike in all sessions. Triangles of the two references' stars give the transform, else their phase correlation a shift. It is
    believed if VERIFY_STARS stars or more come nearer than VERIFY_RADIUS pixels to one of the master's, and VERIFY_RESIDUAL at most on average.
    """
    chief = masters.select(by, F.col(group).alias("_master"))
    rows = references.select(by, group, key).join(chief, by)
    picked = frames.join(references.select(group, key), [group, key]).select(group, F.col("pixels").alias("target"))
    base = picked.select(F.col(group).alias("_master"), F.col("target").alias("base"))

    def shifted(target: np.ndarray, base: np.ndarray) -> tuple:
        return correlate(base.reshape(height, width), target.reshape(height, width))

    moved = map_frames(rows.where(F.col(group) != F.col("_master")).join(picked, group).join(base, "_master"), [by, group, "_master"], ["target", "base"], shifted, "dx double, dy double")
    pairs = moved.withColumn("pair", F.xxhash64(group))
    own = stars.join(references.select(group, key), [group, key]).select(group, "star_id", "x", "y")
    left = own.join(pairs.select(group, "pair", "dx", "dy"), group).select("pair", "star_id", "x", "y", "dx", "dy").toDF("pair", "star_id", "x", "y", "dx", "dy")
    right = own.withColumnRenamed(group, "_master").join(pairs.select("_master", "pair"), "_master").select("pair", "star_id", "x", "y").toDF("pair", "star_id", "x", "y")

    def solved(f: np.ndarray, r: np.ndarray, dx: float, dy: float) -> tuple:
        found = triangle_similarity(f, r)
        how = found[:4] if found else (1.0, 0.0, -dx, -dy)
        return *how, *residual(f, r, *how)

    found = _solve_pairs(left, right, "pair", solved, "a double, b double, tx double, ty double, matched int, mean_residual double", ["dx", "dy"])
    sure = F.coalesce((F.col("matched") >= VERIFY_STARS) & (F.col("mean_residual") <= VERIFY_RESIDUAL), F.lit(False))
    others = pairs.select(by, group, "pair").join(found, "pair", "left").withColumn("solved", sure)
    columns = [by, group, "a", "b", "tx", "ty", "matched", "mean_residual", "solved"]
    none = {"matched": F.lit(None).cast("int"), "mean_residual": F.lit(None).cast("double"), "solved": F.lit(True)}
    same = rows.where(F.col(group) == F.col("_master")).withColumns({"a": F.lit(1.0), "b": F.lit(0.0), "tx": F.lit(0.0), "ty": F.lit(0.0)} | none)
    return others.select(*columns).unionByName(same.select(*columns))


def across_groups(contributed: DataFrame, crossed: DataFrame, by: str, group: str, key: str) -> DataFrame:
    """``contributions`` of groups as those of their sessions: each frame's transform, then its group's (``cross_transforms``). Frames of groups
    without a believed one are out (CrossGroupFailed)."""
    outer = crossed.select(by, group, F.struct("a", "b", "tx", "ty").alias("_outer"), F.col("solved").alias("_solved"))
    both = compose(F.col("_outer"), transform(*(F.col(c) for c in ("a", "b", "tx", "ty"))))
    joined = contributed.join(outer, group).withColumn("_both", both)
    reason = F.when(~F.col("_solved"), "CrossGroupFailed").otherwise(F.col("exclusion_reason"))
    return joined.select(by, group, key, (F.col("included") & F.col("_solved")).alias("included"), reason.alias("exclusion_reason"), "background_level", "_both.*")


def stack_tiles(frames: DataFrame, contributed: DataFrame, by: str, key: str, width: int, height: int, channels: int = 1, clip: float = CLIP) -> DataFrame:
    """(by, first, n, mean, sigma, kept, stacked) of ``combine_tiles``: the included frames of a group over their backgrounds, moved onto the reference and combined.

    contributed: as ``contributions`` or ``across_groups`` gives it. Transforms that turn by less than LEAST_TURN only shift. One map moves a frame and cuts it into tiles, which
    are shuffled once; the tile's size follows from the largest group, so a task's memory does not.
    """
    used = _used(contributed, by, key)
    most = used.groupBy(by).count().agg(F.max("count")).first()[0] or 1
    level = frames.select(by, key, "pixels").join(used, [by, key]).withColumn("pixels", over_background(F.col("pixels"), F.col("background_level")))
    placed = resample_frames(level, [by, key], ["a", "b", "tx", "ty"], width, height, channels)
    return combine_tiles(cut_tiles(placed, [by], tile_pixels(most, channels), channels), [by], channels, clip)


def _used(contributed: DataFrame, by: str, key: str) -> DataFrame:
    turned = (F.abs(F.atan2("b", "a")) >= LEAST_TURN) | (F.col("a") < 0.5)
    plain = {"a": F.when(turned, F.col("a")).otherwise(1.0), "b": F.when(turned, F.col("b")).otherwise(0.0)}
    return contributed.where("included").select(by, key, "background_level", "a", "b", "tx", "ty").withColumns(plain)


def stack_frames(frames: DataFrame, contributed: DataFrame, by: str, key: str, width: int, height: int, crop: bool = True, channels: int = 1) -> DataFrame:
    """(by, x, y, n, kept, stacked), a row a pixel of ``stack_tiles``; frames of three channels (interleaved) give (by, x, y, kept, r, g, b).

    With ``crop`` only the rectangle stays that every frame covers with pixels of its own. ``contributed``, a few numbers a frame, is computed once.
    """
    contributed = materialised(contributed)
    tiles = stack_tiles(frames, contributed, by, key, width, height, channels)
    columns, names = (["kept"], {"r": 0, "g": 1, "b": 2}) if channels == 3 else (["n", "kept"], {"stacked": 0})
    rows = pixel_rows(tiles, [by], columns, names)
    combined = rows.select(by, (F.col("i") % width).cast("int").alias("x"), F.expr(f"i div {width}").cast("int").alias("y"), *(F.col(c).cast("long").alias(c) for c in columns), *names)
    if not crop:
        return combined
    box = overlap(with_inner_bounds(_used(contributed, by, key), [by], width, height), by)
    return combined.join(box, by).where("x >= x0 AND x < x1 AND y >= y0 AND y < y1").select(*combined.columns)
