"""Document fingerprints by Order MinHash (operator 6).

A k-mer and the number of its occurrence in the text are one element, so repeats count. Each of
``FUNCTIONS`` hash functions picks the ``PICKED`` elements of least hash; their k-mers, in text order, are
hashed as a tuple. The share of equal tuples falls with edit distance, order included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesieve.llm.common import durable, mix64, segment_count, small_batches, text_pieces, window_hashes

KMER, PICKED, FUNCTIONS = 8, 2, 64
#: Bytes of text in a range of documents that one task reads, in passing; places sampled for each range's bound.
RANGE_BYTES, SAMPLED = 64 << 20, 20
#: Most ranges: of each the driver sees SAMPLED places and a first one. It bounds no rows.
MOST_RANGES = 8192
#: Elements hashed by all functions at once.
BLOCK = 1 << 13

_SEEDS = mix64(np.arange(1, 2 * FUNCTIONS + 1, dtype=np.uint64))
_FLIP = (_SEEDS[:FUNCTIONS] >> np.uint64(32)).astype(np.uint32)[:, None]
_TIMES = ((_SEEDS[FUNCTIONS:] >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[:, None]
_ROWS = np.arange(FUNCTIONS)


def _numbered(kmers: np.ndarray) -> np.ndarray:
    """32-bit hashes of (k-mer, number of its occurrence)."""
    ordered = np.sort(kmers)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    number = np.zeros(len(kmers), np.uint64)
    if len(again):
        at = np.searchsorted(again, kmers)
        at[at == len(again)] = 0
        place = np.flatnonzero(again[at] == kmers)
        place = place[np.argsort(kmers[place], kind="stable")]
        own = kmers[place]
        fresh = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        number[place] = np.arange(len(own)) - np.repeat(fresh, np.diff(np.append(fresh, len(own))))
    return (mix64(kmers + number * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def signature(points: np.ndarray) -> np.ndarray:
    """FUNCTIONS tuple hashes (uint32) of a text given as code points; all 0 for the empty text.

    A text shorter than a k-mer is one k-mer; with fewer than PICKED k-mers the tuple is shorter. Of equal hashes
    the one earlier in the text is picked.
    """
    if not len(points):
        return np.zeros(FUNCTIONS, np.uint32)
    kmers = window_hashes(points.astype(np.uint64) + np.uint64(1), min(KMER, len(points)))
    elements = _numbered(kmers)
    least, places = [], []
    for low in range(0, len(elements), BLOCK):
        values = (elements[low : low + BLOCK] ^ _FLIP) * _TIMES
        for _ in range(min(PICKED, values.shape[1])):
            at = values.argmin(axis=1)
            least.append(values[_ROWS, at])
            places.append(at + low)
            values[_ROWS, at] = 0xFFFFFFFF
    least, places = np.array(least), np.array(places)
    if len(least) > PICKED:
        order = np.lexsort([places, least], axis=0)[:PICKED]
        places = np.take_along_axis(places, order, axis=0)
    places.sort(axis=0)
    out = np.zeros(FUNCTIONS, np.uint64)
    for row in places:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C55) + kmers[row] + np.uint64(1))
    return (out >> np.uint64(32)).astype(np.uint32)


def text_signature(text: str) -> np.ndarray:
    return signature(np.frombuffer(text.encode("utf-32-le"), np.uint32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal tuples, 0 to 1."""
    return float((a == b).mean())


def as_hex(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): the signature of each whole text in hexadecimal; null counts as empty, repeated rows each give a row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_hex(text_signature(x or "")) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(made, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (id long, no_id, text) dealt into ranges: (part, guard, id, no_id, text), so that within a part, sorted by guard, descending
    id, content (a hash of the text) and text, every row but the guard is followed by its next document.

    Bounds come from a sample of (id, content), so rows of equal id are spread as well unless their texts are equal too. For each
    range its first place comes to the driver, and rows of that place go to the range before it as well, as guards; after the last document comes
    the first again. There are MOST_RANGES at most, so sample and first places stay small; a larger range only means a longer sort, which spills. Texts are read twice: for their size and hash, and to be dealt.
    """
    keyed = docs.withColumns({"down": F.bitwise_not("id"), "content": F.xxhash64("text")})  # ascending ~id is descending id
    places = durable(keyed.select("down", "content", F.octet_length("text").alias("size")))
    size, count = places.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = min(segment_count(size, docs.sparkSession, RANGE_BYTES), MOST_RANGES)
    every = max(1, count // (SAMPLED * ranges))
    sample = places.where(F.pmod(F.xxhash64("content", "down"), F.lit(every)) == 0).select("down", "content").toArrow()
    downs, contents = sample.column("down").to_numpy(), sample.column("content").to_numpy()
    order = np.lexsort((contents, downs))
    order = order[np.unique(np.arange(1, ranges) * len(order) // ranges)] if len(order) else order
    low, low_content = downs[order], contents[order]

    def ranges_of(down: np.ndarray, content: np.ndarray) -> np.ndarray:
        """How many bounds come before or at each row."""
        out, last = np.searchsorted(low, down, "left"), np.searchsorted(low, down, "right")
        for i in np.flatnonzero(last > out).tolist():
            out[i] += np.searchsorted(low_content[out[i] : last[i]], content[i], "right")
        return out

    @F.pandas_udf(T.IntegerType())
    def range_of(down: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series(ranges_of(down.to_numpy(np.int64), content.to_numpy(np.int64)).astype(np.int32))

    firsts = places.groupBy(range_of("down", "content").alias("part")).agg(F.min(F.struct("down", "content")).alias("first"))
    heads = sorted((r["part"], r["first"]["down"], r["first"]["content"]) for r in firsts.collect())
    guards: dict[tuple[int, int], int] = {(down, content): before for (_, down, content), (before, _, _) in zip(heads, heads[-1:] + heads[:-1], strict=True)}
    heads_down = {down for down, _ in guards}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def parts_of(down: pd.Series, content: pd.Series) -> pd.Series:
        d, c = down.to_numpy(np.int64), content.to_numpy(np.int64)
        return pd.Series([[p, -1 - guards[x, y]] if x in heads_down and (x, y) in guards else [p] for p, x, y in zip(ranges_of(d, c).tolist(), d.tolist(), c.tolist(), strict=True)])

    spread = keyed.withColumn("p", F.explode(parts_of("down", "content")))
    spread = spread.select(F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p")).alias("part"), (F.col("p") < 0).alias("guard"), "id", "no_id", "text", "down", "content")
    return spread.repartitionById(ranges, "part").sortWithinPartitions("part", "guard", "down", "content", "text").drop("down", "content")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many of the next
    document, by descending id; after the last document comes the first. Null texts are empty; null ids
    come after all others; rows of equal id are ordered by a hash of their text; a table of one row is its own next; an
    empty table gives no row. Other columns are not read. Texts are shuffled once, by range of id and hash.
    """
    lowest = F.lit(int(np.iinfo(np.int64).min))
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("id"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (part, id, text, signature) of the row whose next is awaited
        for batch in text_pieces(batches):
            out = []
            for part, guard, own, no_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if guard and before is None:
                    continue
                mine = text_signature(text)
                if before is not None:
                    _, last, last_text, last_signature = before
                    half = len(last_text) // 2
                    edited = last_text[: len(last_text) - half] + text[:half]
                    theirs = text_signature(edited)
                    out.append((last, len(last_text), hashlib.sha256(edited.encode()).hexdigest(), as_hex(last_signature), as_hex(theirs), likeness(last_signature, theirs), likeness(last_signature, mine)))
                before = None if guard else (part, None if no_id else own, text, mine)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(given).mapInArrow(compared, schema).withColumnRenamed("id", id_col)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
