"""Image files as rows and rows as image files.

Files are listed and read by Spark's binary source, one row a file; decoding is a map over them, so a
session of any size is as many tasks as it has splits. Header-only scans list the files and read their headers alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree.ElementTree import ParseError

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.functions.paths import basename
from framesieve.sources import fits, xisf
from framesieve.sources.files import ImageFile, store_of

READERS = {"fit": fits.read, "fits": fits.read, "fts": fits.read, "xisf": xisf.read}
SCHEMA = "path string, filename string, width int, height int, channels int, bit_depth string, color_space string, keywords map<string, struct<value: string, comment: string>>, pixels array<float>, error string"
_FIELDS = [c.split(" ")[0] for c in "path, filename, width, height, channels, bit_depth, color_space, keywords, pixels, error".split(", ")]


def _row(path: str, content: bytes) -> dict:
    row: dict = dict.fromkeys(_FIELDS) | {"path": path, "filename": path.rsplit("/", 1)[-1]}
    reader = READERS.get(path.rsplit(".", 1)[-1].lower())
    if reader is None:
        return row | {"error": "unsupported file type"}
    try:
        image = reader(content)
    except (ValueError, KeyError, IndexError, ParseError) as e:
        return row | {"error": f"unreadable: {e}"}
    return row | image | {"keywords": {k: {"value": v, "comment": c} for k, (v, c) in image["keywords"].items()}}


def _head(path: str) -> dict:
    """The row of a file of which the header alone is read."""
    row: dict = dict.fromkeys(_FIELDS) | {"path": path, "filename": path.rsplit("/", 1)[-1]}
    try:
        with ImageFile(path) as file:
            return row | file.image | {"keywords": {k: {"value": v, "comment": c} for k, (v, c) in file.image["keywords"].items()}}
    except (ValueError, KeyError, IndexError, ParseError) as e:
        return row | {"error": f"unreadable: {e}"}


def _replace(path: str, data: bytes) -> None:
    """Writes a file so that it is there under its name only whole; nothing is left behind if that fails."""
    from uuid import uuid4

    store, place = store_of(path)
    part = f"{place.rsplit('/', 1)[0]}/.{uuid4().hex}.part"
    try:
        with store.open_output_stream(part) as out:
            out.write(data)
        store.move(part, place)
    except BaseException:
        store.delete_file(part)
        raise


def read_images(spark: SparkSession, paths: str | list[str], pixels: bool = True, loaded: DataFrame | None = None) -> DataFrame:
    """One row per image file under the given folders, files or globs (folders are not searched in depth), in SCHEMA.

    A file that cannot be read is a row with ``error``; other file types are left out, and so are the paths in ``loaded``.
    """
    files = spark.read.format("binaryFile").load(paths).where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*READERS))
    if loaded is not None:
        files = files.join(loaded.select("path"), "path", "left_anti")

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):  # one frame in memory at a time
                yield pd.DataFrame([_row(path, content)], columns=_FIELDS)

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_head(path) for path in batch["path"]], columns=_FIELDS)

    return files.select("path", "content").mapInPandas(decoded, SCHEMA) if pixels else files.select("path").mapInPandas(headed, SCHEMA)


def update_headers(images: DataFrame) -> DataFrame:
    """Writes the keywords of image rows (path, keywords) into their own files, in the format each has; returns (path, error).

    The pixels stay byte for byte in FITS files; XISF files are written anew. A file is replaced once its new form is whole. The work is done when the result is computed.
    """

    def updated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, given in zip(batch["path"], batch["keywords"], strict=True):
                given = given if isinstance(given, dict) else dict(given or {})
                keywords = {k: (v["value"], v["comment"]) for k, v in given.items()}
                try:
                    store, place = store_of(path)
                    with store.open_input_file(place) as file:
                        data = file.read()
                    _replace(path, xisf.write(xisf.read(data) | {"keywords": keywords}) if path.lower().endswith(".xisf") else fits.with_keywords(data, keywords))
                    out.append((path, None))
                except (ValueError, KeyError, IndexError, OSError) as e:
                    out.append((path, str(e)))
            yield pd.DataFrame(out, columns=["path", "error"])

    return images.select("path", "keywords").mapInPandas(updated, "path string, error string")


def rewrite_images(images: DataFrame) -> DataFrame:
    """Writes image rows, pixels too, over their own files, in the format each has; returns (path)."""

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                given = row["keywords"] if isinstance(row["keywords"], dict) else dict(row["keywords"] or {})
                image = row | {"keywords": {k: (v["value"], v["comment"]) for k, v in given.items()}}
                _replace(row["path"], xisf.write(image) if row["path"].lower().endswith(".xisf") else fits.write(image))
                yield pd.DataFrame([(row["path"],)], columns=["path"])

    return images.where("error IS NULL").select("path", "width", "height", "channels", "bit_depth", "color_space", "keywords", "pixels").mapInPandas(written, "path string")


def session_frames(images: DataFrame, session: str) -> DataFrame:
    """images with the session's name, without those that could not be read."""
    return images.where("error IS NULL").withColumn("session", F.lit(session)).withColumn("name", basename(F.col("path")))


def write_images(images: DataFrame, folder: str, kind: str = "fit", overwrite: bool = False, compress: bool = False) -> DataFrame:
    """Writes every row as ``<stem>.<kind>`` into a folder (a path or URI that all executors reach); returns (file, written).

    An existing file is kept unless ``overwrite``. A file appears under its name only once it is whole, so
    a task that runs again does no harm. The rows are written when the result is computed.
    """
    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for row in batch.to_dict("records"):
                name = f"{row['filename'].rsplit('.', 1)[0]}.{kind}"
                target = f"{base}/{name}"
                fresh = overwrite or store.get_file_info(target).type == fs.FileType.NotFound
                if fresh:
                    keywords = row["keywords"] if isinstance(row["keywords"], dict) else dict(row["keywords"] or {})
                    image = row | {"keywords": {k: (v["value"], v["comment"]) for k, v in keywords.items()}}
                    _replace(f"{folder.rstrip('/')}/{name}", xisf.write(image, compress) if kind == "xisf" else fits.write(image))
                yield pd.DataFrame([(name, fresh)], columns=["file", "written"])

    return images.where("error IS NULL").select("filename", "width", "height", "channels", "bit_depth", "keywords", "pixels").mapInPandas(written, "file string, written boolean")
