"""Substring dedup (operator 4) by difference-cover anchors.

A window is ``WINDOW`` consecutive words of one text. Short anchors are hashed only at word positions
whose residue modulo ``PERIOD`` is in ``COVER``. Every residue is a difference of two members of COVER,
so two equal windows, wherever they start, both have an anchor at one common offset below PERIOD, and
these anchors are equal. Hence only windows around an anchor that occurs twice can repeat; those alone are
extended to windows, each hashed whole (96 bits), and of equal ones all but the first are marked. Extending one occurrence of an
anchor against another, pair by pair, would be quadratic for a frequent anchor, and against its first occurrence alone
would miss windows that only later ones share; windows of equal hash meet whatever their anchor's first occurrence holds.

1. Anchors are gathered by hash range (each batch sends an anchor once); those seen twice go into a Bloom
   filter of bounded size. If they are too many for it, hash ranges of anchors are taken in turn.
2. Windows around anchors that the filter holds are gathered by hash; each batch sends one of equal windows,
   the first, and knows the others as repeats. A false positive of the filter costs a window, not an error.
3. Marks meet their texts by a hash of the document's id and text, and the covered words go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.llm.common import (
    BloomBits,
    durable,
    find_words,
    flat_text,
    joined_words,
    pack,
    partition_count,
    segment_count,
    segment_edges,
    small_batches,
    text_bytes,
    text_pieces,
    unpack,
    whole_windows,
    window_hashes,
    word_hashes,
)

WINDOW = 20
#: A perfect difference set: every residue modulo 13 is a difference of two of these.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Hashes a task gathers before it sends them on.
GATHER = 2_000_000
#: Most bytes of the broadcast filter, bits for each repeated anchor, probes.
FILTER_BYTES, BITS_EACH, PROBES = 128 << 20, 12, 5
_NULL_ID = np.iinfo(np.int64).max


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = flat_text(column)
    starts, ends, at = find_words(data, offsets)
    return data, starts, ends, at, word_hashes(data, starts, ends)


def _anchors(at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of texts that hold a window; positions count the words of all texts."""
    place = whole_windows(at, ANCHOR)
    owner = np.searchsorted(at, place, "right") - 1
    taken = np.isin((place - at[owner]) % PERIOD, COVER) & (np.diff(at)[owner] >= WINDOW)
    place = place[taken]
    return place, window_hashes(hashes, ANCHOR)[place]


def _repeated_anchors(docs: DataFrame, segments: int) -> DataFrame:
    """(segment, n, anchors): the packed, sorted hashes of the anchors that occur more than once."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            hashes, counts = np.unique(np.concatenate(waiting), return_counts=True)
            edges, rows = segment_edges(hashes, segments), []
            for s in np.flatnonzero(np.diff(edges)).tolist():
                own, many = hashes[edges[s] : edges[s + 1]], counts[edges[s] : edges[s + 1]] > 1
                rows.append((s, pack(own[~many]), pack(own[many])))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["segment", "once", "more"])

        for batch in text_pieces(batches):
            _, _, _, at, hashes = _words(batch.column(1))
            waiting.append(_anchors(at, hashes)[1])
            if sum(map(len, waiting)) >= GATHER:
                yield send()
                waiting = []
        if sum(map(len, waiting)):
            yield send()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repeated(segment: int, parts: list[np.ndarray], sure: list[np.ndarray]) -> pa.RecordBatch:
            hashes, counts = np.unique(np.concatenate([*parts, *sure]), return_counts=True)
            own = np.union1d(hashes[counts > 1], np.concatenate(sure))
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([pack(own)], pa.binary())], names=["segment", "n", "anchors"])

        now, parts, sure = None, [], []
        for batch in batches:
            for segment, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != now and now is not None:
                    yield repeated(now, parts, sure)
                    parts, sure = [], []
                now = segment
                parts.append(unpack(once, np.uint64))
                sure.append(unpack(more, np.uint64))
        if now is not None:
            yield repeated(now, parts, sure)

    gathered = docs.select("id", "text").mapInArrow(sent, "segment int, once binary, more binary").repartition(partition_count(segments), "segment").sortWithinPartitions("segment")
    return gathered.mapInArrow(met, "segment int, n long, anchors binary")


def _filter(anchors: DataFrame, segments: int, part_words: int, turn: int, rounds: int) -> BloomBits:
    """The filter of every ``rounds``-th anchor; its size is bounded by FILTER_BYTES, so it may pass through the driver."""

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x[x % np.uint64(rounds) == turn] for x in (unpack(x, np.uint64) for x in batch.column(1).to_pylist())]
            parts = [BloomBits.filled_part(x, s, part_words, segments, PROBES) for s, x in zip(batch.column(0).to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], names=["segment", "words"])

    words = np.zeros(segments * part_words, np.uint64)
    for row in anchors.select("segment", "anchors").mapInArrow(filled, "segment int, words binary").toLocalIterator(prefetchPartitions=True):
        words[row.segment * part_words : (row.segment + 1) * part_words] = np.frombuffer(row.words, np.uint64)
    return BloomBits(words, segments, PROBES)


#: A window on its way: two hashes, its document (id, and a hash of id and text that tells rows of equal id apart) and its first word.
_WINDOW_FIELDS = (("hash", np.uint64), ("more", np.uint32), ("id", np.int64), ("row", np.uint32), ("place", np.int32))


def _later(fields: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(windows sorted by hash and then by id and place, which of them start after an equal one)."""
    order = np.lexsort([fields[4], fields[2], fields[1], fields[0]])
    fields = [x[order] for x in fields]
    h, m, d, _, p = fields
    fresh = np.append(True, (h[1:] != h[:-1]) | (m[1:] != m[:-1]))
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
    return fields, (d != d[first]) | (p != p[first])


def _mark_rows(fields: list[np.ndarray], buckets: int) -> tuple[list, list]:
    """Repeated windows by bucket of their document: (buckets, packed (id, row, place))."""
    _, _, d, r, p = fields
    bucket = r % np.uint32(buckets)
    order = np.lexsort([p, d, bucket])
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    own = np.flatnonzero(np.diff(edges)).tolist()
    return own, [_joined([x[order[edges[b] : edges[b + 1]]] for x in (d, r, p)]) for b in own]


def _joined(fields: list[np.ndarray]) -> bytes:
    return b"".join(map(pack, fields))


def _parted(packed: bytes, kinds: tuple) -> list[np.ndarray]:
    n, out, at = len(packed) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        to = at + n * np.dtype(k).itemsize
        out.append(unpack(packed[at:to], k))
        at = to
    return out


def _marks(docs: DataFrame, bloom, segments: int, buckets: int) -> DataFrame:
    """(bucket, marks): windows that repeat an earlier one, from those around anchors in the filter."""
    kinds = tuple(k for _, k in _WINDOW_FIELDS)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = bloom.value, [[] for _ in kinds]

        def send() -> pa.RecordBatch:
            fields, later = _later([np.concatenate(x) for x in waiting])
            own, marks = _mark_rows([x[later] for x in fields], buckets)
            fields = [x[~later] for x in fields]
            same = np.append(False, (fields[0][1:] == fields[0][:-1]) & (fields[1][1:] == fields[1][:-1]) & (fields[2][1:] == fields[2][:-1]) & (fields[3][1:] == fields[3][:-1]))
            fields = [x[~same] for x in fields]  # repeated rows send a window once
            edges = segment_edges(fields[0], segments)
            full = np.flatnonzero(np.diff(edges)).tolist()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*[-1 - b for b in own], *full], pa.int32()),
                    pa.array([*marks, *[_joined([x[edges[s] : edges[s + 1]] for x in fields]) for s in full]], pa.binary()),
                ],
                names=["key", "packed"],
            )

        for batch in text_pieces(batches):
            _, _, _, at, hashes = _words(batch.column(2))
            place, anchor = _anchors(at, hashes)
            place = place[held.holds(anchor)]
            near = np.zeros(len(hashes) + 1, np.int32)
            np.add.at(near, np.maximum(place - PERIOD + 1, 0), 1)
            np.add.at(near, place + 1, -1)
            fits = whole_windows(at, WINDOW)
            fits = fits[np.cumsum(near)[fits] > 0]
            owner = np.searchsorted(at, fits, "right") - 1
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
            for x, y in zip(waiting, (window_hashes(hashes, WINDOW)[fits], (window_hashes(hashes, WINDOW, 1)[fits] >> np.uint64(32)).astype(np.uint32), ids[owner], rows[owner], (fits - at[owner]).astype(np.int32)), strict=True):
                x.append(y)
            if sum(map(len, waiting[0])) >= GATHER:
                yield send()
                waiting = [[] for _ in kinds]
        if sum(map(len, waiting[0])):
            yield send()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[bytes]) -> pa.RecordBatch:
            fields, later = _later([np.concatenate(x) for x in zip(*(_parted(p, kinds) for p in parts), strict=True)])
            own, marks = _mark_rows([x[later] for x in fields], buckets)
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(marks, pa.binary())], names=["bucket", "marks"])

        now, parts = None, []
        for batch in batches:
            for key, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key < 0:  # known as repeats where they were read
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - key], pa.int32()), pa.array([packed], pa.binary())], names=["bucket", "marks"])
                    continue
                if key != now and now is not None:
                    yield found(parts)
                    parts = []
                now = key
                parts.append(packed)
        if now is not None:
            yield found(parts)

    gathered = docs.select("id", "row", "text").mapInArrow(sent, "key int, packed binary").repartition(partition_count(segments), "key").sortWithinPartitions("key")
    return gathered.mapInArrow(met, "bucket int, marks binary")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed`` and ``kept``, the kept words joined by one blank.

    A word goes if a window over it has the same words as a window that starts earlier: in a
    document of smaller id, or earlier in the same document. Windows are judged on the input. A null text has no
    words; null ids come after all others and count as one document; rows of equal id count as one document,
    so equal rows leave each other alone and each give a row, but are dealt by id and text. Texts shorter than a window keep their words. Other columns are
    not read; an empty table gives no row.
    """
    spark = docs.sparkSession
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(_NULL_ID))).alias("id"), F.col(id_col).isNull().alias("no_id"), F.col(text_col).alias("text"))
    given = given.withColumn("row", F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 32) - 1)))
    segments = segment_count(text_bytes(given), spark)
    anchors = durable(_repeated_anchors(given, segments))
    total = anchors.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rounds = max(1, -(-total * BITS_EACH // (8 * FILTER_BYTES)))
    part_words = max(1, -(-total * BITS_EACH // (64 * segments * rounds)))
    marks = None
    for turn in range(rounds):
        held = _filter(anchors, segments, part_words, turn, rounds)
        found = _marks(given, spark.sparkContext.broadcast(held), segments, segments)
        marks = found if marks is None else marks.union(found)
    texts = given.select((F.col("row") % segments).cast("int").alias("bucket"), "id", "no_id", "text", F.lit(None).cast("binary").alias("marks"), "row")
    none = F.lit(None).cast("long")
    both = marks.select("bucket", none.alias("id"), F.lit(False).alias("no_id"), F.lit(None).cast("string").alias("text"), "marks", none.alias("row")).union(texts)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, known = None, [], None
        for batch in text_pieces(batches, "text"):
            buckets, given_marks = batch.column(0).to_numpy(), batch.column(4)
            for bucket in np.unique(buckets).tolist():
                rows = np.flatnonzero(buckets == bucket)
                if bucket != now:
                    now, parts, known = bucket, [], None
                part = batch.slice(rows[0], len(rows))
                is_mark = np.flatnonzero(given_marks.slice(rows[0], len(rows)).is_valid().to_numpy(zero_copy_only=False))
                parts += [part.column(4)[i].as_py() for i in is_mark.tolist()]
                part = part.slice(len(is_mark))
                if part.num_rows:
                    if known is None:
                        known = _sorted_marks(parts)
                    yield _without(part, known)

    dealt = both.repartition(partition_count(segments), "bucket").sortWithinPartitions(F.col("bucket"), F.col("marks").isNull())
    out = dealt.mapInArrow(kept, "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


def _sorted_marks(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int32)
    d, r, p = (np.concatenate(x) for x in zip(*(_parted(x, (np.int64, np.uint32, np.int32)) for x in parts), strict=True))
    order = np.lexsort([r, d])
    return d[order], r[order], p[order]


def _without(batch: pa.RecordBatch, marks: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """The rows' texts without the words under marked windows."""
    data, offsets = flat_text(batch.column(3))
    starts, ends, at = find_words(data, offsets)
    ids, rows = batch.column(1).to_numpy(), batch.column(5).to_numpy().astype(np.uint32)
    low, high = np.searchsorted(marks[0], ids), np.searchsorted(marks[0], ids, "right")
    cover = np.zeros(len(starts) + WINDOW + 1, np.int32)
    for i in np.flatnonzero(high > low).tolist():
        own = marks[2][low[i] : high[i]][marks[1][low[i] : high[i]] == rows[i]]
        own = own[own + WINDOW <= at[i + 1] - at[i]] + at[i]
        np.add.at(cover, own, 1)
        np.add.at(cover, own + WINDOW, -1)
    keep = np.cumsum(cover)[: len(starts)] == 0
    kept_at = np.append(0, np.cumsum(keep))[at]
    text, offsets = joined_words(data, starts[keep], ends[keep])
    raw, bounds = text.tobytes(), offsets[kept_at].tolist()
    texts = [raw[s : max(s, e - 1)].decode() for s, e in zip(bounds, bounds[1:], strict=False)]
    counts = np.diff(at)
    owners = pa.array(ids, pa.int64(), mask=batch.column(2).to_numpy(zero_copy_only=False))
    return pa.RecordBatch.from_arrays([owners, pa.array(counts, pa.int64()), pa.array(counts - np.diff(kept_at), pa.int64()), pa.array(texts, pa.string())], names=["id", "n_words", "n_removed", "kept"])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    kept = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same by hashing every window, for DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)
), later AS (
  SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM later
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT w.doc_id, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.p) AS text
  FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id AND w.p = c.p WHERE c.p IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
