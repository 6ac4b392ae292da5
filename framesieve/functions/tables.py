"""Table functions and aggregates that SQL can call: stars, triangles and clipped backgrounds.

``register`` makes them known to a session:

    SELECT f.frame, s.* FROM frames f, LATERAL frame_stars(f.width, f.height, f.luma) s
    SELECT g, clipped_background(v) FROM pixels GROUP BY g
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from framesieve.operators.stars import DETECTION, STAR_SCHEMA, clipped_background, star_table

_STARS = ", ".join(STAR_SCHEMA.split(", ")[1:])
_NAMES = [c.split()[0] for c in _STARS.split(", ")]
_INTS = {c.split()[0] for c in _STARS.split(", ") if c.endswith(" int")}


class FrameStars:
    """Stars of one frame, as ``detect_stars`` finds and numbers them; a null frame has none."""

    def eval(self, width: int, height: int, luma: list) -> Iterator[tuple]:
        if luma is None:
            return
        for star in star_table(np.asarray(luma, float).reshape(height, width), DETECTION)[_NAMES].itertuples(index=False):
            yield tuple(int(v) if n in _INTS else None if np.isnan(v) else float(v) for n, v in zip(_NAMES, star, strict=True))


class StarTriangles:
    """Triangles of a frame's stars (array of structs with star_id, x and y): their ids in ascending order, and their sides, the longest first. Three stars on one point give zeros."""

    def eval(self, stars: list[Row]) -> Iterator[tuple]:
        places = sorted((s["star_id"], float(s["x"]), float(s["y"])) for s in stars or [])
        for (i, ax, ay), (j, bx, by), (k, cx, cy) in combinations(places, 3):
            yield i, j, k, *sorted((float(np.hypot(ax - bx, ay - by)), float(np.hypot(bx - cx, by - cy)), float(np.hypot(cx - ax, cy - ay))), reverse=True)


def _clipped(v: pd.Series) -> float | None:
    kept = v.dropna().to_numpy(float)
    return clipped_background(kept)[0] if len(kept) else None


def register(spark: SparkSession) -> None:
    """Table functions ``frame_stars`` and ``star_triangles``, and the grouped Arrow aggregate ``clipped_background`` (the clipped median of a group's values without nulls; a group is an
    image's sample, which fits a task)."""
    spark.udtf.register("frame_stars", F.udtf(FrameStars, returnType=_STARS))
    spark.udtf.register("star_triangles", F.udtf(StarTriangles, returnType="star_a int, star_b int, star_c int, longest double, middle double, shortest double"))
    spark.udf.register("clipped_background", F.pandas_udf(_clipped, "double", F.PandasUDFType.GROUPED_AGG))
