"""What the text operators share: Arrow text as numpy arrays, hashes, and tables that outlive executors.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so every position here is a
position in UTF-8 bytes unless a name says otherwise.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Sub-batches handed to numpy code hold about so many bytes of text.
PIECE_BYTES = 1 << 20
#: Partitions of a shuffle; it bounds no rows, only how many segments lie in one partition.
MOST_PARTITIONS = 1 << 16

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def durable(df: DataFrame) -> DataFrame:
    """The same rows, read from the cluster's shared checkpoint folder from now on.

    The folder is the session's spark.checkpoint.dir; see ``shared_folder``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for checkpoints: spark.checkpoint.dir.

    Only a session whose executors are threads of the driver (master local) may leave it unset, as in tests; it gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def quoted(name: str) -> str:
    """A column's name as Spark reads it whole, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def unused(names: list[str], taken: list[str]) -> list[str]:
    """``names``, each followed by as many underscores as tell it from the ``taken`` ones (capitals or not)."""
    known, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def map_whole(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], added: list[T.StructField]) -> DataFrame:
    """``df`` with columns ``added`` behind its own; ``function`` gets batches whose columns are named c0, c1, ... (Spark maps no
    columns with dots in their names) and yields the columns of whole batches, old and new."""
    fields = [*df.schema.fields, *added]
    plain = [f"c{i}" for i in range(len(fields))]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays(columns, names=plain)

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(plain, fields, strict=True)])
    return df.toDF(*plain[: len(df.columns)]).mapInArrow(mapped, schema).toDF(*(f.name for f in fields))


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, records: int = 2000, size: str = "8m") -> None:
    """Arrow batches small enough that a few tasks' batches of long texts fit beside the heap; a smaller setting stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > records:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_bytes(spark_df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, for sizing partitions and segments."""
    from pyspark.sql import functions as F

    return spark_df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text); null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if column.type == pa.large_string() else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows so that each piece holds about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat_text(batch.column(batch.schema.names.index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def find_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start and end byte of each word, offsets of each text's words). ``separator``: which of the 256 bytes stand between words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = separator[data]
    opens, closes = np.empty(len(data), bool), np.empty(len(data), bool)
    opens[0], closes[-1] = True, True
    opens[1:], closes[:-1] = gap[:-1], gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    opens[inner], closes[inner - 1] = True, True
    starts, ends = np.flatnonzero(opens & ~gap), np.flatnonzero(closes & ~gap) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _grow_powers(n: int) -> None:
    global _powers, _inverse_powers
    if len(_powers) < n:
        steps = np.full(n, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = _BASE_INVERSE
        _inverse_powers = np.cumprod(steps, dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of a polynomial in an odd base."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + chunk, "right")))
        s, e = starts[at:to] - base, ends[at:to] - base
        _grow_powers(int(e[-1]) + 1)
        sums = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum((data[base : base + e[-1]].astype(np.uint64) + np.uint64(1)) * _powers[: e[-1]], out=sums[1:])
        out[at:to] = (sums[e] - sums[s]) * _inverse_powers[s]
        at = to
    return mix64(out)


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """For each i the hash of hashes[i : i + width]; the last width - 1 windows are left out.

    A polynomial in an odd base that ``seed`` picks; windows of powers of two are joined, so it takes log(width) passes.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = int(mix64(np.array([seed + 1], np.uint64))[0]) | 1
    part, length, out, done = hashes, 1, None, 0
    while done < width:
        if width & length:
            out = part[:n] if out is None else out * np.uint64(pow(base, length, 1 << 64)) + part[done : done + n]
            done += length
        if done < width:
            part = part[: len(part) - length] * np.uint64(pow(base, length, 1 << 64)) + part[length:]
            length *= 2
    return mix64(out)


def whole_windows(word_offsets: np.ndarray, width: int) -> np.ndarray:
    """Positions (of words of all texts) at which a window of ``width`` words fits into its text."""
    total = int(word_offsets[-1])
    if total < width:
        return np.zeros(0, np.int64)
    fits = np.ones(total - width + 1, bool)
    for back in range(1, width):
        edge = word_offsets[1:-1] - back
        edge = edge[(edge >= 0) & (edge < len(fits))]
        fits[edge] = False
    return np.flatnonzero(fits)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the words' bytes with one blank after each word, offsets of the words in them)."""
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[ends] -= 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts + 1, out=offsets[1:])
    inside = np.ones(int(offsets[-1]), bool)
    inside[offsets[1:] - 1] = False
    out = np.full(len(inside), 0x20, np.uint8)
    out[inside] = data[np.cumsum(edges[:-1], dtype=np.int8).view(bool)]
    return out, offsets


def pack(values: np.ndarray) -> bytes:
    """The array byte plane by byte plane: planes that vary little take no room once compressed."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unpack(packed: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def segment_count(text_size: int, spark: SparkSession, each: int = 8 << 20) -> int:
    """Into how many hash ranges to deal what is gathered from ``text_size`` bytes of text; a task holds one range at a time."""
    return int(max(parallelism(spark), text_size // each))


def partition_count(segments: int) -> int:
    """Into how many partitions to deal so many segments: each has one, until Spark's books of partitions would grow too long; then some share one."""
    return min(segments, MOST_PARTITIONS)


def segment_edges(hashes: np.ndarray, segments: int) -> np.ndarray:
    """Offsets of the segments in sorted hashes; segment s holds hashes with floor(h / 2**32 * segments / 2**32) = s."""
    high = (hashes >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
    return np.searchsorted(high, np.arange(segments + 1, dtype=np.uint64))


class BloomBits:
    """A Bloom filter over 64-bit hashes as a flat array of 64-bit words.

    It is made of parts by hash range (the same ranges as ``segment_edges``), so that each part can be
    filled by the task that holds its hashes.
    """

    def __init__(self, words: np.ndarray, parts: int, probes: int) -> None:
        self.words, self.parts, self.probes = words, parts, probes

    @staticmethod
    def places(hashes: np.ndarray, part_words: int, parts: int, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each probe (index of the 64-bit word in the whole filter, bit in it)."""
        part = (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        base = part * np.uint64(part_words)
        state = mix64(hashes)
        for _ in range(probes):
            yield base + ((state >> np.uint64(32)) * np.uint64(part_words) >> np.uint64(32)), np.uint64(1) << (state & np.uint64(63))
            state = mix64(state + _BASE)

    @classmethod
    def filled_part(cls, hashes: np.ndarray, part: int, part_words: int, parts: int, probes: int) -> bytes:
        words = np.zeros(part_words, np.uint64)
        for at, bit in cls.places(hashes, part_words, parts, probes):
            np.bitwise_or.at(words, (at - np.uint64(part * part_words)).astype(np.int64), bit)
        return words.tobytes()

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at, bit in self.places(hashes, len(self.words) // self.parts, self.parts, self.probes):
            found &= (self.words[at.astype(np.int64)] & bit) != 0
        return found
