"""Image files as a data source of Spark: ``spark.read.format("frames")`` and ``df.write.format("frames")``, once ``register`` has been called.

Reading: the schema says what is read. Headers are read by range; a file's samples only where the schema has ``pixels`` and the row passes the pushed filters. Columns of
other names are header keys. Files can be cut into bands of rows with border rows, so that one large frame is the work of several tasks. ``scan_images`` sets all this.

Writing: tasks write parts beside the folder's files, and the job's commit names them; a job that fails leaves the folder as it was.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4
from xml.etree.ElementTree import ParseError

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framesieve.sources import fits, xisf
from framesieve.sources.files import ImageFile, kind_of, store_of

_ENTRY = T.StructType([T.StructField("value", T.StringType()), T.StructField("comment", T.StringType())])
#: What a row can hold; other names are header keys, as text. ``row0``, ``rows``: the band's own rows; ``above``, ``below``: border rows that its pixels hold too.
_KINDS: dict[str, T.DataType] = {
    "path": T.StringType(),
    "filename": T.StringType(),
    "width": T.IntegerType(),
    "height": T.IntegerType(),
    "channels": T.IntegerType(),
    "bit_depth": T.StringType(),
    "color_space": T.StringType(),
    "keywords": T.MapType(T.StringType(), _ENTRY),
    "pixels": T.ArrayType(T.FloatType()),
    "row0": T.IntegerType(),
    "rows": T.IntegerType(),
    "above": T.IntegerType(),
    "below": T.IntegerType(),
    "bytes_read": T.LongType(),
    "error": T.StringType(),
}
SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in _KINDS.items()])
#: Bytes of a file up to which it is one band, unless a number of rows is given.
BAND_BYTES = 64 << 20
_FILTERED = (D.EqualTo, D.In, D.IsNotNull, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual, D.StringStartsWith, D.StringEndsWith, D.StringContains)


@dataclass
class Band(D.InputPartition):
    """One of ``of`` bands of a file."""

    path: str
    number: int
    of: int


def _passes(filters: list[D.Filter], row: dict) -> bool:
    for f in filters:
        value = row[f.attribute[0]]
        ok = value is not None
        if ok and isinstance(f, D.EqualTo):
            ok = value == f.value
        elif ok and isinstance(f, D.In):
            ok = value in f.value
        elif ok and isinstance(f, D.GreaterThan):
            ok = value > f.value
        elif ok and isinstance(f, D.GreaterThanOrEqual):
            ok = value >= f.value
        elif ok and isinstance(f, D.LessThan):
            ok = value < f.value
        elif ok and isinstance(f, D.LessThanOrEqual):
            ok = value <= f.value
        elif ok and isinstance(f, D.StringStartsWith):
            ok = value.startswith(f.value)
        elif ok and isinstance(f, D.StringEndsWith):
            ok = value.endswith(f.value)
        elif ok and isinstance(f, D.StringContains):
            ok = f.value in value
        if not ok:
            return False
    return True


class FrameReader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.filters = schema, []
        self.paths = options["path"].split(",")
        self.band_rows, self.halo, self.align = (int(options.get(k, d)) for k, d in (("bandRows", "0"), ("halo", "0"), ("align", "1")))
        self.names = [f.name for f in schema.fields]
        for f in schema.fields:
            if f.dataType != _KINDS.get(f.name, T.StringType()):
                raise ValueError(f"column {f.name} is {_KINDS.get(f.name, T.StringType()).simpleString()}, not {f.dataType.simpleString()}")

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            known = len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in self.names and f.attribute[0] not in ("pixels", "keywords", "bytes_read", "row0", "rows", "above", "below", "error")
            if isinstance(f, _FILTERED) and known:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Band]:
        """A band for each file, or several; only names and sizes are looked at."""
        from pyarrow import fs

        out = []
        for given in self.paths:
            store, place = store_of(given)
            info = store.get_file_info(place)
            found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place)) if info.type == fs.FileType.Directory else []
            prefix = given if info.type == fs.FileType.File else given.rstrip("/") + "/"
            for f in sorted(found, key=lambda f: f.path):
                if f.type == fs.FileType.File and kind_of(f.path) and not f.base_name.startswith((".", "_")):
                    path = prefix if info.type == fs.FileType.File else prefix + f.base_name
                    known = {"path": path, "filename": f.base_name}
                    if not _passes([x for x in self.filters if x.attribute[0] in known], known):
                        continue
                    of = max(1, -(-f.size // BAND_BYTES)) if self.band_rows >= 0 and "pixels" in self.names and (self.band_rows or self.halo or "row0" in self.names) else 1
                    out += [Band(path, i, of) for i in range(of)]
        return out or [Band("", 0, 0)]

    def read(self, band: Band) -> Iterator[pa.RecordBatch]:
        if band.of:
            yield from (self._batch(row) for row in self._rows(band) if row is not None)

    def _batch(self, row: dict) -> pa.RecordBatch:
        schema = to_arrow_schema(self.schema)
        cells = []
        for field in schema:
            value = row.get(field.name)
            if field.name == "pixels" and value is not None:
                cells.append(pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), pa.array(value)).cast(field.type))
            elif field.name == "keywords" and value is not None:
                cells.append(pa.array([[(k, {"value": v, "comment": c}) for k, (v, c) in value.items()]], field.type))
            else:
                cells.append(pa.array([value], field.type))
        return pa.RecordBatch.from_arrays(cells, schema=schema)

    def _rows(self, band: Band) -> Iterator[dict]:
        row = {"path": band.path, "filename": band.path.rsplit("/", 1)[-1]}
        keys = [n for n in self.names if n not in _KINDS]
        try:
            with ImageFile(band.path) as file:
                row |= file.image
                row |= {k: (row["keywords"].get(k.upper()) or (None,))[0] for k in keys}
                if not _passes(self.filters, dict.fromkeys(self.names) | row):
                    return
                if "pixels" not in self.names:
                    if band.number == 0:
                        yield row | {"bytes_read": file.bytes_read}
                    return
                for first, last in self._own(band, file):
                    above, below = min(self.halo, first), min(self.halo, row["height"] - last)
                    before = file.bytes_read
                    pixels = file.rows(first - above, last + below).ravel()
                    yield row | {"pixels": pixels, "row0": first, "rows": last - first, "above": above, "below": below, "bytes_read": file.bytes_read - (before if first else 0)}
        except (ValueError, KeyError, IndexError, OSError, ParseError) as e:
            failed = dict.fromkeys(self.names) | {"path": band.path, "filename": row["filename"], "error": f"unreadable: {e}"}
            if band.number == 0 and _passes(self.filters, failed):
                yield failed

    def _own(self, band: Band, file: ImageFile) -> list[tuple[int, int]]:
        """The rows (from, to before) of the bands that a task reads: bands are whole multiples of ``align`` rows, dealt evenly to a file's tasks; a file that cannot be read in parts is all the first task's."""
        height = file.image["height"]
        if not (self.band_rows or self.halo or "row0" in self.names):
            return [(0, height)]
        rows = self.band_rows or max(1, -(-height // band.of))
        rows = -(-rows // self.align) * self.align
        starts = list(range(0, height, rows))
        own = (starts if band.number == 0 else []) if not file.parts else starts[len(starts) * band.number // band.of : len(starts) * (band.number + 1) // band.of]
        return [(s, min(s + rows, height)) for s in own]


class Written(D.WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class FrameWriter(D.DataSourceWriter):
    """Parts are named by attempt, so an attempt that is lost leaves nothing that the commit would name."""

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool) -> None:
        self.folder, self.kind, self.compress = options["path"].rstrip("/"), options.get("kind", "fit"), options.get("compress", "false") == "true"
        self.existing = options.get("existing", "replace" if overwrite else "keep")
        if self.existing not in ("keep", "replace", "error") or kind_of(f"x.{self.kind}") is None:
            raise ValueError(f"no such way: existing={self.existing}, kind={self.kind}")
        lacking = {"filename", "width", "height", "channels", "bit_depth", "keywords", "pixels"} - {f.name for f in schema.fields}
        if lacking:
            raise ValueError(f"columns are missing: {sorted(lacking)}")
        self.parts = f"{self.folder}/.parts-{uuid4().hex}"

    def write(self, rows: Iterator[T.Row]) -> Written:
        store, base = store_of(self.parts)
        store.create_dir(base, recursive=True)
        written = []
        for row in rows:
            keywords = {k: (v["value"], v["comment"]) for k, v in (row["keywords"] or {}).items()}
            image = {c: row[c] for c in ("width", "height", "channels", "bit_depth")} | {"keywords": keywords, "pixels": np.asarray(row["pixels"], np.float32)}
            if row["pixels"] is None or len(row["pixels"]) != row["width"] * row["height"] * row["channels"]:
                raise ValueError(f"{row['filename']} does not have width * height * channels samples")
            part = f"{uuid4().hex}.{self.kind}"
            with store.open_output_stream(posixpath.join(base, part)) as out:
                out.write(xisf.write(image, self.compress) if kind_of(part) is xisf else fits.write(image))
            written.append((part, f"{os.path.splitext(row['filename'])[0]}.{self.kind}"))
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        """Names the parts. Two rows of one name, and with existing=error a name that is taken, stop it before anything is named."""
        from pyarrow import fs

        store, base = store_of(self.folder)
        _, parts = store_of(self.parts)
        files = [x for m in messages if m is not None for x in m.files]
        names = [name for _, name in files]
        try:
            if len(set(names)) < len(names):
                raise ValueError(f"several rows are named {next(n for n in names if names.count(n) > 1)}")
            taken = {f.base_name for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True))}
            if self.existing == "error" and taken & set(names):
                raise ValueError(f"there is a file {min(taken & set(names))} already")
            for part, name in files:
                if name not in taken or self.existing == "replace":
                    store.move(posixpath.join(parts, part), posixpath.join(base, name))
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, parts = store_of(self.parts)
        if store.get_file_info(parts).type.name == "Directory":
            store.delete_dir(parts)


class FrameSource(D.DataSource):
    """Options of reading: ``path`` (files or folders, parted by commas; folders are not searched in depth), ``bandRows``, ``halo``, ``align``; of writing: ``path``, ``kind`` (fit or
    xisf), ``compress``, ``existing`` (keep, replace or error; keep, if mode is append)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> FrameReader:
        return FrameReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``frames`` known to the session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)


def scan_images(spark: SparkSession, paths: str | list[str], columns: list[str], band_rows: int = 0, halo: int = 0, align: int = 1) -> DataFrame:
    """Rows of image files with just ``columns``: names of SCHEMA, or header keys (text, null where a file lacks them).

    Without ``pixels`` only headers are read. With ``band_rows``, ``halo`` or a column ``row0`` a file is several rows: bands of ``band_rows`` rows, in whole multiples of ``align``, with up to
    ``halo`` border rows above and below. A file that cannot be read is a row with ``error``.
    """
    register(spark)
    fields = [T.StructField(c, _KINDS.get(c, T.StringType())) for c in columns]
    given = [paths] if isinstance(paths, str) else paths
    return spark.read.format("frames").schema(T.StructType(fields)).option("bandRows", band_rows).option("halo", halo).option("align", align).load(",".join(given))
