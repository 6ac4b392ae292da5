"""Suffix-array dedup (operator 13): transforms of shards merged by iterative interleave refinement.

One transform of all suffixes would be one task's work, so the suffixes taken are those at anchors. The anchor of a 200-byte string is its
32-byte substring of least hash, the leftmost of equal ones: equal strings have equal anchors at equal places. Consecutive strings of one anchor
make a segment; its text from the anchor on and, read backwards, before the anchor are two suffixes. A shard (what a task
gathers before it sends) sorts its segments by anchor and following text and sends them in that order to the hash ranges of
their anchors, equal segments once.

1. A first pass counts anchors by hash range. Those seen twice go into a Bloom filter of bounded size; if there are too many for it, hash ranges of anchors are
   taken in turn. Without a repeated anchor no string repeats.
2. A range merges its shards' transforms: all start as one interleave, block by block of equal anchors; iteration d reads each row's d-th byte and
   deals the rows of a block stably by it. A border between two rows appears in the iteration that equals their common prefix, so these come as the interleave is
   refined, rows alone in a block drop out, and no suffix is sorted again. This is done forwards and backwards. Strings with o bytes before the anchor are equal where both the
   backward prefixes of o and the forward prefixes of 200 - o bytes are: bytes decide, not hashes.
3. Segments of anchors with more than HOT occurrences do not fit one range (a passage that a third of all documents hold, in as many surroundings); their strings go singly, by
   96-bit hashes, equal ones of a shard once.
4. Repeated strings, joined to spans, meet their texts by a hash of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.llm.common import BloomBits, durable, flat_text, mix64, pack, partition_count, segment_count, segment_edges, small_batches, text_bytes, text_pieces, unpack, window_hashes

#: Bytes of a string and of its anchor.
LENGTH, ANCHOR = 200, 32
#: Bytes before and from the anchor on that a segment can have.
LEFT, RIGHT = LENGTH - ANCHOR, LENGTH
#: Occurrences from which on an anchor's strings go singly.
HOT = 20_000
#: What a task holds before it sends: anchors, segments' occurrences, their bytes, strings.
HELD_ANCHORS, HELD_SEGMENTS, HELD_BYTES, HELD_STRINGS = 500_000, 300_000, 12 << 20, 300_000
#: Most bytes of a broadcast filter, bits for each anchor, probes.
FILTER_BYTES, BITS_EACH, PROBES = 128 << 20, 12, 5
#: Bytes of what one task merges at a time, and of texts looked at in one step.
RANGE_BYTES, PIECE_BYTES = 4 << 20, 1 << 18

_MARKS, _SEGMENTS, _STRINGS = 0, 1, 2
_DEALT = "part int, rows array<struct<kind: int, range: int, packed: binary>>"
_DEALT_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("range", pa.int32()), ("packed", pa.binary())]))
_SEGMENT_FIELDS = (np.uint64, np.int64, np.int64, np.int32, np.uint8, np.uint8, np.uint8)  # anchor, id, row, its place, bytes before it, from it on, known to repeat
_STRING_FIELDS = (np.uint64, np.uint32, np.int64, np.int64, np.int32, np.uint8)  # two hashes, id, row, place, known to repeat
_SPAN_FIELDS = (np.int64, np.int64, np.int32, np.int32)  # row, id, from, to


def _joined(fields: list[np.ndarray]) -> bytes:
    return b"".join(map(pack, fields))


def _parted(packed: bytes, kinds: tuple) -> list[np.ndarray]:
    n, out, at = len(packed) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        to = at + n * np.dtype(k).itemsize
        out.append(unpack(packed[at:to], k))
        at = to
    return out


def _compressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _expanded(packed: bytes) -> bytes:
    return pa.Codec("zstd", 1).decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def _dealt_batch(parts: list[int], rows: list[list[dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(rows, _DEALT_TYPE)], names=["part", "rows"])


def _by_range(keys: np.ndarray, ranges: int, parts: int, kind: int, packed) -> Iterator[tuple[int, dict]]:
    """(part, row) of sorted 64-bit keys: a row for each range, so that a shard sends one row a part. packed(from, to) gives a row's bytes."""
    edges = segment_edges(keys, ranges)
    for r in np.flatnonzero(np.diff(edges)).tolist():
        yield r % parts, {"kind": kind, "range": r, "packed": packed(int(edges[r]), int(edges[r + 1]))}


def _sent(rows: Iterator[tuple[int, dict]]) -> pa.RecordBatch:
    by_part: dict[int, list[dict]] = {}
    for part, row in rows:
        by_part.setdefault(part, []).append(row)
    return _dealt_batch(list(by_part), list(by_part.values()))


def _deal(df: DataFrame, parts: int) -> DataFrame:
    """(kind, range, packed), the rows of a range behind one another: dealt by part, split into ranges in the receiving task."""
    return df.repartition(parts, "part").select(F.explode("rows").alias("x")).select("x.kind", "x.range", "x.packed").sortWithinPartitions("kind", "range")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(kind, range, rows) of what ``_deal`` gives."""
    now, held = None, []
    for batch in batches:
        for kind, own, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (kind, own) != now:
                if held:
                    yield *now, held
                now, held = (kind, own), []
            held.append(packed)
    if held:
        yield *now, held


class _Piece:
    """The anchors of some texts: for each segment the place of its anchor, and its first and last string's place."""

    def __init__(self, column: pa.Array) -> None:
        self.data, self.offsets = flat_text(column)
        wide = self.data.astype(np.uint64) + np.uint64(1)
        self.wide = wide
        hashes = window_hashes(wide, ANCHOR)
        none = np.zeros(0, np.int64)
        self.place = self.first = self.last = self.owner = none
        self.anchor = np.zeros(0, np.uint64)
        width, done = LENGTH - ANCHOR + 1, 1
        if len(hashes) < width:
            return
        least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
        while done * 2 <= width:
            least, done = np.minimum(least[:-done], least[done:]), done * 2
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
        end = np.repeat(self.offsets[1:], np.diff(self.offsets))[: len(least)]
        starts = np.flatnonzero(np.arange(LENGTH, LENGTH + len(least)) <= end)
        if not len(starts):
            return
        at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        fresh = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        self.place, self.first, self.last = at[fresh], starts[fresh], starts[np.append(fresh[1:], len(starts)) - 1]
        self.anchor = mix64(hashes[self.place])  # least hashes lie low; mixed, they spread over all ranges
        self.owner = np.searchsorted(self.offsets, self.place, "right") - 1


def _count_anchors(docs: DataFrame, ranges: int, parts: int) -> DataFrame:
    """(range, n, n_hot, total, anchors, hot): packed, sorted hashes of the anchors that occur more than once and more than HOT times; total: occurrences of the others of these."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            own, n = np.unique(np.concatenate(waiting), return_counts=True)
            n = n.astype(np.uint32)
            return _sent(_by_range(own, ranges, parts, _SEGMENTS, lambda a, b: _joined([own[a:b], n[a:b]])))

        for batch in text_pieces(batches, limit=PIECE_BYTES):
            waiting.append(_Piece(batch.column(2)).anchor)
            if sum(map(len, waiting)) >= HELD_ANCHORS:
                yield send()
                waiting = []
        if sum(map(len, waiting)):
            yield send()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own, rows in _groups(batches):
            hashes, n = (np.concatenate(x) for x in zip(*(_parted(r, (np.uint64, np.uint32)) for r in rows), strict=True))
            hashes, at = np.unique(hashes, return_inverse=True)
            n = np.bincount(at, n).astype(np.int64)
            more, hot = hashes[n > 1], hashes[n > HOT]
            total = int(n[(n > 1) & (n <= HOT)].sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([own], pa.int32()), *(pa.array([x], pa.int64()) for x in (len(more), len(hot), total)), *(pa.array([pack(x)], pa.binary()) for x in (more, hot))], names=["range", "n", "n_hot", "total", "anchors", "hot"]
            )

    dealt = _deal(docs.select("id", "row", "text").mapInArrow(sent, _DEALT), parts)
    return dealt.mapInArrow(met, "range int, n long, n_hot long, total long, anchors binary, hot binary")


def _filter(anchors: DataFrame, column: str, ranges: int, part_words: int, turn: int, rounds: int) -> BloomBits:
    """The filter of every ``rounds``-th anchor of a column; its size is bounded by FILTER_BYTES, so it may pass through the driver."""

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x[x % np.uint64(rounds) == turn] for x in (unpack(x, np.uint64) for x in batch.column(1).to_pylist())]
            parts = [BloomBits.filled_part(x, s, part_words, ranges, PROBES) for s, x in zip(batch.column(0).to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], names=["range", "words"])

    words = np.zeros(ranges * part_words, np.uint64)
    for r in anchors.select("range", column).mapInArrow(filled, "range int, words binary").toLocalIterator(prefetchPartitions=True):
        words[r.range * part_words : (r.range + 1) * part_words] = np.frombuffer(r.words, np.uint64)
    return BloomBits(words, ranges, PROBES)


def _spans(row: np.ndarray, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Spans of bytes by row and id, those that touch joined."""
    if not len(row):
        return [np.zeros(0, k) for k in _SPAN_FIELDS]
    order = np.lexsort([start, ids, row])
    row, ids, start, end = (x[order] for x in (row, ids, start, end))
    fresh = np.append(True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]))
    base = np.cumsum(fresh).astype(np.int64) << 32
    reach = np.maximum.accumulate(base + end)
    opens = np.append(True, (base + start)[1:] > reach[:-1])
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(row)) - 1
    return [row[at], ids[at], start[at].astype(np.int32), (reach[last] - base[last]).astype(np.int32)]


def _span_rows(spans: list[np.ndarray], buckets: int, parts: int) -> Iterator[tuple[int, dict]]:
    """(part, row) of spans, by the bucket of their text."""
    bucket = spans[0] % buckets
    order = np.argsort(bucket, kind="stable")
    spans, bucket = [x[order] for x in spans], bucket[order]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=False):
        yield int(bucket[a]) % parts, {"kind": _MARKS, "range": int(bucket[a]), "packed": _joined([x[a:b] for x in spans])}


class _Shard:
    """What a task has gathered of segments and strings."""

    def __init__(self) -> None:
        self.segments: list[list[np.ndarray]] = []
        self.texts: list[np.ndarray] = []
        self.strings: list[list[np.ndarray]] = []
        self.texts_of: set[tuple[int, int]] = set()
        self.n_segments = self.n_bytes = self.n_strings = 0

    def full(self) -> bool:
        return self.n_segments >= HELD_SEGMENTS or self.n_bytes >= HELD_BYTES or self.n_strings >= HELD_STRINGS

    def add(self, piece: _Piece, ids: np.ndarray, rows: np.ndarray, held: BloomBits, hot: BloomBits | None) -> None:
        taken = held.holds(piece.anchor)
        heavy = taken & hot.holds(piece.anchor) if hot is not None else np.zeros(len(taken), bool)
        self._add_segments(piece, np.flatnonzero(taken & ~heavy), ids, rows)
        if heavy.any():
            self._add_strings(piece, np.flatnonzero(heavy), ids, rows)

    def _add_segments(self, piece: _Piece, own: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        place, first, end, owner = piece.place[own], piece.first[own], piece.last[own] + LENGTH, piece.owner[own]
        content = mix64(_range_hashes(piece.wide, first, end)) ^ (place - first).astype(np.uint64)
        order = np.lexsort([content, piece.anchor[own]])
        anchor, content = piece.anchor[own][order], content[order]
        fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]))[: len(order)]
        one = np.flatnonzero(fresh)
        pairs = list(zip(anchor[one].tolist(), content[one].tolist(), strict=True))
        fresh[one] = [pair not in self.texts_of for pair in pairs]
        self.texts_of.update(pairs)
        size = np.where(fresh, (end - first)[order], 0)  # the text of an occurrence that is not the shard's first is not kept
        at = np.repeat(first[order] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        self.texts.append(piece.data[at])
        self.segments.append(
            [anchor, content, ids[owner][order], rows[owner][order], (place - piece.offsets[owner])[order].astype(np.int32), (place - first)[order].astype(np.uint8), (end - place)[order].astype(np.uint8), size.astype(np.int64)]
        )
        self.n_segments, self.n_bytes = self.n_segments + len(order), self.n_bytes + len(at)

    def _add_strings(self, piece: _Piece, own: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        size = piece.last[own] - piece.first[own] + 1
        start = np.repeat(piece.first[own] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        owner = np.repeat(piece.owner[own], size)
        more = (window_hashes(piece.wide, LENGTH, 1)[start] >> np.uint64(32)).astype(np.uint32)
        self.strings.append([window_hashes(piece.wide, LENGTH)[start], more, ids[owner], rows[owner], (start - piece.offsets[owner]).astype(np.int32)])
        self.n_strings += len(start)

    def sent(self, ranges: int, buckets: int, parts: int) -> pa.RecordBatch:
        found, out = [], []
        if self.n_segments:
            own, data, begin, spans = self._transform()
            found.append(spans)
            size = own[4].astype(np.int64) + own[5]

            def packed(a: int, b: int) -> bytes:
                at = np.repeat(begin[a:b] - np.append(0, np.cumsum(size[a:b])[:-1]), size[a:b]) + np.arange(size[a:b].sum())
                return _compressed(np.int64(b - a).tobytes() + _joined([x[a:b] for x in own]) + data[at].tobytes())

            out += _by_range(own[0], ranges, parts, _SEGMENTS, packed)
        if self.n_strings:
            h, m, d, r, p = (np.concatenate(x) for x in zip(*self.strings, strict=True))
            order = np.lexsort([m, h])
            h, m, d, r, p = (x[order] for x in (h, m, d, r, p))
            fresh = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])))
            times = np.diff(np.append(fresh, len(h)))
            again = np.repeat(times > 1, times)
            found.append(_spans(r[again], d[again], p[again], p[again] + LENGTH))
            own = [*(x[fresh] for x in (h, m, d, r, p)), (times > 1).astype(np.uint8)]
            out += _by_range(own[0], ranges, parts, _STRINGS, lambda a, b: _joined([x[a:b] for x in own]))
        for spans in found:
            out += _span_rows(spans, buckets, parts)
        return _sent(iter(out))

    def _transform(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
        """(the shard's different segments by anchor and the text that follows, texts, where in them each segment's is, spans of the segments that the shard holds more than once)."""
        anchor, content, ids, rows, place, left, right, size = (np.concatenate(x) for x in zip(*self.segments, strict=True))
        data = np.concatenate(self.texts)
        self.texts, self.texts_of = [], set()
        begin = np.append(0, np.cumsum(size)[:-1])
        order = np.lexsort([size == 0, content, anchor])  # an occurrence whose text is kept before those whose is not
        fresh = np.flatnonzero(np.append(True, (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])))
        times = np.diff(np.append(fresh, len(order)))
        again = order[np.repeat(times > 1, times)]
        spans = _spans(rows[again], ids[again], place[again] - left[again], place[again] + right[again])
        one, known = order[fresh], (times > 1).astype(np.uint8)
        follows = _matrix(data, begin[one] + left[one], right[one], RIGHT)
        rank = np.argsort(np.ascontiguousarray(follows).view(f"S{RIGHT}").ravel(), kind="stable")
        rank = rank[np.argsort(anchor[one][rank], kind="stable")]
        one, known = one[rank], known[rank]
        return [anchor[one], ids[one], rows[one], place[one], left[one], right[one], known], data, begin[one], spans


def _range_hashes(wide: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each start to its end."""
    base = int(mix64(np.array([7], np.uint64))[0]) | 1
    n = len(wide)
    powers, inverse = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    powers, inverse = np.cumprod(powers), np.cumprod(inverse)
    sums = np.append(np.uint64(0), np.cumsum(wide * powers[:n]))
    return (sums[end] - sums[start]) * inverse[start]


def _matrix(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """One row of ``width`` bytes for each start, read forwards or backwards, 0 behind its length."""
    column = np.arange(width)[None, :]
    out = np.zeros((len(start), width), np.uint8)
    for i in range(0, len(start), 2048):
        inside = column < length[i : i + 2048, None]
        at = start[i : i + 2048, None] + step * column
        out[i : i + 2048][inside] = data[at[inside]]
    return out


def refine_interleave(columns: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, for each place in it the common prefix with the row before it, at most the number of columns and -1 where that is of another block).

    columns: the rows' d-th bytes at [d]. The order is by block and bytes; equal rows stay in the order given.
    """
    depth, n = columns.shape
    order = np.argsort(blocks, kind="stable")
    block = blocks[order]
    prefix = np.full(n, depth, np.int32)
    border = np.append(True, block[1:] != block[:-1])[:n]
    prefix[border] = -1
    place = np.arange(n)
    block = np.cumsum(border)

    def shared(block: np.ndarray) -> np.ndarray:
        same = block[1:] == block[:-1]
        return np.append(same, False) | np.append(False, same)

    for d in range(depth):
        many = shared(block)
        if not many.all():
            place, block = place[many], block[many]
        if not len(place):
            break
        byte = columns[d][order[place]]
        within = block[1:] == block[:-1]
        differs = (byte[1:] != byte[:-1]) & within
        if not differs.any():
            continue
        mixed = np.zeros(int(block[-1]) + 1, bool)
        mixed[block[1:][differs]] = True
        own = np.flatnonzero(mixed[block])  # only blocks of more than one byte are dealt anew
        moved = own[np.argsort(block[own].astype(np.int64) << 8 | byte[own], kind="stable")]
        order[place[own]], byte[own] = order[place[moved]], byte[moved]
        border = (byte[1:] != byte[:-1]) & within
        prefix[place[1:][border]] = d
        block = block + np.append(0, np.cumsum(border))
    return order, prefix


def _merged(rows: list[bytes]) -> list[np.ndarray]:
    """Spans of the repeated strings of a range's segments, from the transforms of its shards."""
    fields, texts = [], []
    width = sum(np.dtype(k).itemsize for k in _SEGMENT_FIELDS)
    for packed in map(_expanded, rows):
        end = 8 + int(np.frombuffer(packed[:8], np.int64)[0]) * width
        fields.append(_parted(packed[8:end], _SEGMENT_FIELDS))
        texts.append(np.frombuffer(packed[end:], np.uint8))
    anchor, ids, row, place, left, right, known = (np.concatenate(x) for x in zip(*fields, strict=True))
    left, right, data = left.astype(np.int64), right.astype(np.int64), np.concatenate(texts)
    begin = np.append(0, np.cumsum(left + right)[:-1])
    _, blocks, times = np.unique(anchor, return_inverse=True, return_counts=True)
    many = np.flatnonzero(times[blocks] > 1)  # a segment alone with its anchor repeats nowhere else
    ids, row, place, left, right, known, begin, blocks = (x[many] for x in (ids, row, place, left, right, known, begin, blocks))
    n = len(many)
    if not n:
        return [np.zeros(0, k) for k in _SPAN_FIELDS]
    middle = begin + left
    forward, prefix = refine_interleave(np.ascontiguousarray(_matrix(data, middle, right, RIGHT).T), blocks)
    backward, suffix = refine_interleave(np.ascontiguousarray(_matrix(data, middle - 1, left, LEFT, -1).T), blocks)
    repeated = np.zeros((LEFT + 3, n), bool)
    before, after = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(LEFT + 1):
        own = np.flatnonzero((left >= o) & (right >= LENGTH - o))
        if len(own) < 2:
            continue
        before[backward], after[forward] = np.cumsum(suffix < o), np.cumsum(prefix < LENGTH - o)
        key = before[own] * (n + 1) + after[own]
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        again = np.append(same, False) | np.append(False, same)
        repeated[o + 1, own[order[again]]] = True
    repeated[:, known > 0] = False  # these are marked where they were read
    change = np.diff(repeated.astype(np.int8), axis=0).T  # by segment, then by bytes before the anchor
    seg, low = np.nonzero(change == 1)
    _, high = np.nonzero(change == -1)
    return _spans(row[seg], ids[seg], place[seg] - (high - 1), place[seg] - low + LENGTH)


def _met_strings(rows: list[bytes]) -> list[np.ndarray]:
    """Spans of strings that another shard has too."""
    h, m, d, r, p, known = (np.concatenate(x) for x in zip(*(_parted(x, _STRING_FIELDS) for x in rows), strict=True))
    order = np.lexsort([m, h])
    h, m, d, r, p, known = (x[order] for x in (h, m, d, r, p, known))
    same = (h[1:] == h[:-1]) & (m[1:] == m[:-1])
    again = (np.append(same, False) | np.append(False, same)) & (known == 0)
    return _spans(r[again], d[again], p[again], p[again] + LENGTH)


def _repeats(docs: DataFrame, held: BloomBits, hot: BloomBits | None, ranges: int, buckets: int, parts: int) -> DataFrame:
    """(part, rows): spans of bytes under repeated strings, from anchors in the filters."""
    filters = docs.sparkSession.sparkContext.broadcast((held, hot))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = filters.value
        shard = _Shard()
        for batch in text_pieces(batches, limit=PIECE_BYTES):
            ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            shard.add(_Piece(batch.column(2)), ids, rows, held, hot)
            if shard.full():
                yield shard.sent(ranges, buckets, parts)
                shard = _Shard()
                pa.default_memory_pool().release_unused()
        yield shard.sent(ranges, buckets, parts)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, own, rows in _groups(batches):
            if kind == _MARKS:
                yield _dealt_batch([own % parts] * len(rows), [[{"kind": _MARKS, "range": own, "packed": r}] for r in rows])
            else:
                yield _sent(_span_rows((_merged if kind == _SEGMENTS else _met_strings)(rows), buckets, parts))

    dealt = _deal(docs.select("id", "row", "text").mapInArrow(sent, _DEALT), parts)
    return dealt.mapInArrow(met, _DEALT)


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that stay (binary: a sign may be cut).

    A byte goes if a 200-byte string over it, of the document's UTF-8 bytes, also starts anywhere else, in this or any other row; strings are judged on the
    input, and n_spans counts the maximal runs of bytes that go. A null text counts as empty. Rows are documents of their own whatever their ids, so a repeated row of
    200 bytes or more is removed whole, as are all its equals; null ids stay null. Texts under 200 bytes keep their bytes. Other columns are not read; an empty table gives no row.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("doc", "text")).withColumn("id", F.coalesce("doc", F.lit(-1)))
    size = text_bytes(given)
    ranges = segment_count(size // 4, spark, RANGE_BYTES)
    anchors = durable(_count_anchors(given, ranges, partition_count(ranges)))
    total, n_hot, occurrences = anchors.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_hot", "total"))).first()
    rounds = max(1, -(-total * BITS_EACH // (8 * FILTER_BYTES)))
    words = max(1, -(-total * BITS_EACH // (64 * ranges * rounds)))
    hot_words = max(1, -(-n_hot * BITS_EACH // (64 * ranges * rounds)))
    merges = segment_count(min(occurrences * (LENGTH + LENGTH // 3), 4 * size), spark, RANGE_BYTES)  # a text of one sign has an anchor a byte, and few different segments
    buckets = segment_count(size, spark)
    parts = partition_count(max(merges, buckets))
    found = []
    for turn in range(rounds):
        held = _filter(anchors, "anchors", ranges, words, turn, rounds)
        hot = _filter(anchors, "hot", ranges, hot_words, turn, rounds) if n_hot else None
        found.append(_repeats(given, held, hot, merges, buckets, parts))
    bucket = F.pmod("row", F.lit(buckets)).cast("int")
    none = F.lit(None)
    texts = given.select((bucket % parts).alias("part"), none.cast(_DEALT.split("rows ")[1]).alias("rows"), bucket.alias("bucket"), "row", "id", "doc", "text")
    spans = reduce(DataFrame.union, found).select("part", "rows", none.cast("int").alias("bucket"), none.cast("long").alias("row"), none.cast("long").alias("id"), none.cast("long").alias("doc"), none.cast("string").alias("text"))
    both = spans.union(texts).repartition(parts, "part").select(F.explode_outer("rows").alias("x"), "bucket", "row", "id", "doc", "text")
    both = both.select(F.coalesce("x.range", "bucket").alias("bucket"), F.col("x.packed").alias("packed"), "row", "id", "doc", "text").sortWithinPartitions(F.col("bucket"), F.col("packed").isNull())

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, known = None, [], None
        for batch in text_pieces(batches):
            own = batch.column(0).to_numpy()
            for b in np.unique(own).tolist():
                at = np.flatnonzero(own == b)
                if b != now:
                    now, parts, known = b, [], None
                part = batch.slice(at[0], len(at))
                marks = part.column(1).drop_null().to_pylist()
                parts += marks
                part = part.slice(len(marks))
                if part.num_rows:
                    if known is None:
                        known = _spans(*(np.concatenate(x) for x in zip(*(_parted(p, _SPAN_FIELDS) for p in parts), strict=True))) if parts else [np.zeros(0, k) for k in _SPAN_FIELDS]
                    yield _without(part, known)

    out = both.mapInArrow(kept, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("doc", id_col)


def _without(batch: pa.RecordBatch, spans: list[np.ndarray]) -> pa.RecordBatch:
    """The rows' texts without their spans."""
    data, offsets = flat_text(batch.column(5))
    rows, ids = batch.column(2).to_numpy(), batch.column(3).to_numpy()
    low, high = np.searchsorted(spans[0], rows), np.searchsorted(spans[0], rows, "right")
    n = high - low
    at = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    owner = np.repeat(np.arange(len(rows)), n)
    mine = spans[1][at] == ids[owner]
    at, owner = at[mine], owner[mine]
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, offsets[owner] + spans[2][at], 1)
    np.add.at(edge, offsets[owner] + spans[3][at], -1)
    keep = np.cumsum(edge)[:-1] == 0
    bounds = np.append(0, np.cumsum(keep))[offsets]
    raw = data[keep].tobytes()
    size = np.diff(offsets)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(4),
            pa.array(size, pa.int64()),
            pa.array(size - np.diff(bounds), pa.int64()),
            pa.array(np.bincount(owner, minlength=len(rows)), pa.int64()),
            pa.array([raw[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)], pa.binary()),
        ],
        names=["doc", "n_bytes", "n_removed", "n_spans", "kept"],
    )


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    kept = drop_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
