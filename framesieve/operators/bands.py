"""Work on bands of rows: a frame larger than a task likes is several tasks, each with the border rows that it needs.

Bands come from ``scan_images`` (row0, rows, above, below, width, height, channels, pixels), which reads them by range from their files. Results are those of the whole frame, to the last bit;
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesieve.functions.arrays import LUMA
from framesieve.operators.frames import DEPTHS, debayered, debayered_luma, display_step, map_frames, moved_rows, reduced_blocks, source_rows
from framesieve.sources.files import ImageFile

#: Border rows that debayering needs.
HALO = 1


def debayer_bands(bands: DataFrame, keep: list[str], pattern: str | Column = "RGGB", luma: bool = False) -> DataFrame:
    """(keep, row0, rows, values): the bands' own rows of a mosaic's colours (interleaved) or luminance, 0 to 1. Read them with a halo of HALO or more rows."""

    def made(v, width: int, rows: int, row0: int, above: int, below: int, depth: str, order: str) -> tuple:
        if v is None:
            return (None,)
        mosaic = v.astype(float).reshape(above + rows + below, width) / DEPTHS[depth]
        shifted = order[2:] + order[:2] if (row0 - above) % 2 else order  # the pattern as it is at the band's first row
        return ((debayered_luma if luma else debayered)(mosaic, shifted)[above : above + rows].ravel(),)

    given = ["pixels", "width", "rows", "row0", "above", "below", "bit_depth", F.lit(pattern) if isinstance(pattern, str) else pattern]
    return map_frames(bands, [*keep, "row0", "rows"], given, made, "values array<double>")


def luma_bands(bands: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, row0, rows, values): luminance of the bands' own rows of images that are no mosaic: three channels weighted, of other counts the first."""

    def made(v, width: int, rows: int, above: int, channels: int, depth: str) -> tuple:
        if v is None:
            return (None,)
        image = v.astype(float).reshape(-1, width, channels)[above : above + rows] / DEPTHS[depth]
        return ((image[..., 0] * LUMA[0] + image[..., 1] * LUMA[1] + image[..., 2] * LUMA[2] if channels == 3 else image[..., 0]).ravel(),)

    return map_frames(bands, [*keep, "row0", "rows"], ["pixels", "width", "rows", "above", "channels", "bit_depth"], made, "values array<double>")


def reduce_bands(bands: DataFrame, keep: list[str], step: int | None = None) -> DataFrame:
    """(keep, step, row0, rows, width, values): bands of images reduced by block means; row0, rows and width count blocks. Read the bands with ``align`` equal to the step.

    Without a ``step`` it follows from the width (``display_step``). Samples are as stored.
    """

    def made(v, width: int, rows: int, row0: int, above: int, channels: int) -> tuple:
        by = step or display_step(width)
        if v is None:
            return by, None, None, None, None
        if row0 % by:
            raise ValueError(f"a band begins at row {row0}, within a block of {by}: read bands with align={by}")
        out = reduced_blocks(v.astype(float).reshape(-1, width, channels)[above : above + rows], by)
        return by, row0 // by, out.shape[0], out.shape[1], out.ravel()

    return map_frames(bands, keep, ["pixels", "width", "rows", "row0", "above", "channels"], made, "step int, row0 int, rows int, width int, values array<double>").where("rows > 0 OR rows IS NULL")


RESAMPLED = "path string, width int, height int, channels int, row0 int, rows int, values array<double>, bytes_read long, error string"


def resample_bands(transforms: DataFrame, band_rows: int) -> DataFrame:
    """RESAMPLED: files (path, height, a, b, tx, ty; heights as ``scan_images`` reads them) moved by their transforms, bands of ``band_rows`` output rows.

    A task reads of a file only the rows that its band comes from. A file that cannot be read gives a row with ``error`` for each band.
    """

    def moved_bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first, a, b, tx, ty in batch.itertuples(index=False):
                out: dict = dict.fromkeys(c.split()[0] for c in RESAMPLED.split(", ")) | {"path": path, "row0": first}
                try:
                    with ImageFile(path) as file:
                        width, height, channels = (file.image[c] for c in ("width", "height", "channels"))
                        rows = (first, min(first + band_rows, height))
                        low, high = source_rows(rows, height, width, a, b, tx, ty)
                        values = moved_rows(file.rows(low, high).astype(float), low, height, rows, a, b, tx, ty)
                        out |= {"width": width, "height": height, "channels": channels, "rows": rows[1] - rows[0], "values": values.ravel(), "bytes_read": file.bytes_read}
                except (ValueError, KeyError, IndexError, OSError) as e:
                    out["error"] = f"unreadable: {e}"
                yield pd.DataFrame([out])

    starts = F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(band_rows))).alias("first")
    spread = transforms.where("height > 0").select("path", starts, *(F.col(c).cast("double") for c in ("a", "b", "tx", "ty")))
    return spread.mapInPandas(moved_bands, RESAMPLED)
