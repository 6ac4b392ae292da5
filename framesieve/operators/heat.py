"""Pictures of heat maps: values between cells, contour lines, colours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesieve.operators.frames import map_frames

#: Colours of palettes, red, green and blue at even steps from the least to the greatest value.
PALETTES = {
    "viridis": [(68, 1, 84), (71, 44, 122), (59, 81, 139), (44, 113, 142), (33, 145, 140), (39, 173, 129), (92, 200, 99), (170, 220, 50), (253, 231, 37)],
    "plasma": [(13, 8, 135), (75, 3, 161), (125, 3, 168), (168, 34, 150), (203, 70, 121), (229, 107, 93), (248, 148, 65), (253, 195, 40), (240, 249, 33)],
    "coolwarm": [(59, 76, 192), (124, 159, 234), (221, 221, 221), (229, 134, 107), (180, 4, 38)],
}
#: The least range between a map's lowest and highest value.
LEAST_RANGE = 0.01


def surface(cells: np.ndarray, width: int, height: int) -> np.ndarray:
    """(height, width) of values between the centres of a grid's cells (rows, columns), bilinear; beyond the outer centres those of the nearest."""

    def places(size: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(size) + 0.5) / (size / n) - 0.5
        low = np.clip(np.floor(at), 0, n - 1).astype(int)
        return low, np.minimum(low + 1, n - 1), np.clip(at - low, 0.0, 1.0)

    (x0, x1, fx), (y0, y1, fy) = places(width, cells.shape[1]), places(height, cells.shape[0])
    across = cells[:, x0] + (cells[:, x1] - cells[:, x0]) * fx
    return across[y0] + (across[y1] - across[y0]) * fy[:, None]


def crossings(field: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of inner pixels of which one of the four neighbours lies on the other side of ``level``."""
    over = field - level
    mid = over[1:-1, 1:-1]
    y, x = np.nonzero((mid * over[1:-1, 2:] < 0) | (mid * over[1:-1, :-2] < 0) | (mid * over[2:, 1:-1] < 0) | (mid * over[:-2, 1:-1] < 0))
    return y + 1, x + 1


def _heat_rows(cells: DataFrame, by: str) -> DataFrame:
    """(by, grid, values): a heat map's cells (at most 225) as one array, row by row."""
    return cells.groupBy(by, "grid").agg(F.transform(F.array_sort(F.collect_list(F.struct("gy", "gx", "fwhm"))), lambda c: c["fwhm"]).alias("values"))


def contours(cells: DataFrame, by: str, width: int, height: int, levels: int = 10) -> DataFrame:
    """(by, level, value, x, y): pixels on the contour lines of heat maps (by, grid, gx, gy, fwhm; see ``heat_map``) drawn at that size.

    Between cell centres values are bilinear. ``levels`` lines part the range from the map's lowest to its highest cell (LEAST_RANGE at least) evenly; a pixel is on a line if one of its four neighbours is on the
    other side. Pixels at the picture's edge are on none. A map is one row of a map over frames; only its cells are grouped.
    """

    def lines(values: np.ndarray, grid: int) -> tuple:
        field = surface(values.reshape(grid, grid), width, height)
        low, span = values.min(), max(values.max() - values.min(), LEAST_RANGE)
        found = []
        for i in range(1, levels + 1):
            value = low + span * i / (levels + 1)
            found += [{"level": i, "value": float(value), "x": int(x), "y": int(y)} for y, x in zip(*crossings(field, value), strict=True)]
        return (found,)

    drawn = map_frames(_heat_rows(cells, by), [by], ["values", "grid"], lines, "found array<struct<level: int, value: double, x: int, y: int>>")
    return drawn.select(by, F.explode("found").alias("p")).select(by, "p.*")


def heat_pictures(cells: DataFrame, by: str, width: int, height: int, palette: str = "viridis") -> DataFrame:
    """(by, width, height, channels, pixels): heat maps as colour pictures of that size, samples of 0 to 255 interleaved; from lowest to highest cell through a palette's colours."""
    stops = np.array(PALETTES[palette], float)

    def drawn(values: np.ndarray, grid: int) -> tuple:
        field = surface(values.reshape(grid, grid), width, height)
        share = np.clip((field - values.min()) / max(values.max() - values.min(), LEAST_RANGE), 0.0, 1.0) * (len(stops) - 1)
        low = np.minimum(share.astype(int), len(stops) - 2)
        colour = stops[low] + (stops[low + 1] - stops[low]) * (share - low)[..., None]
        return width, height, 3, np.floor(colour + 0.5).astype(np.int32).ravel()

    return map_frames(_heat_rows(cells, by), [by], ["values", "grid"], drawn, "width int, height int, channels int, pixels array<int>")
