"""Language-model scoring (operator 8) with a log-frequency Bloom filter.

Counts of words and word pairs of the training documents are quantised on a logarithmic scale. The filter
holds an n-gram once for every level up to its own, so its level is read off by probing level 1, 2, ...
until a probe fails, and never comes out too low. The filter is filled by hash range where the counts are
gathered; its size grows with the corpus at a fixed number of bits for each entry. Texts are scored by smoothed probabilities from such probes.

A filter of up to ``FILTER_BYTES`` is broadcast. A larger one stays where it is, in parts by hash range, and only the levels
of the most frequent words and pairs (a bounded number) are broadcast: each batch of texts sends its other probes to the parts
and gets the levels back, so scores are the same either way. What a batch sends goes by ranges of many segments, as large as
a task can hold, and a part answers many batches at once: the number of messages and of look-ups would else grow with the square of the corpus.

The unigram base score needs exact counts: those of the most frequent words (a bounded number) are
broadcast, and each batch asks the parts for those of its other words, once for each distinct word.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.llm.common import (
    PIECE_BYTES,
    durable,
    find_words,
    flat_text,
    lower_ascii,
    mix64,
    pack,
    parallelism,
    partition_count,
    segment_count,
    segment_edges,
    small_batches,
    text_bytes,
    text_pieces,
    unpack,
    word_hashes,
)

#: Documents with crc32(id) modulo FOLDS equal to HELD_OUT are not learned from.
FOLDS, HELD_OUT = 5, 1
#: Most bytes of a filter that is broadcast, bits for each (n-gram, level) that it holds, probes of each.
FILTER_BYTES, BITS_EACH, PROBES = 192 << 20, 10, 5
#: Most words whose exact counts are broadcast.
HEAD_WORDS = 1 << 20
#: Most pairs whose levels are broadcast where the filter is not.
HEAD_PAIRS = 1 << 22
#: Bytes of the filter that a range of segments holds, where that makes more than FEW ranges; n-grams that a part looks up at once.
RANGE_BYTES, FEW, AT_ONCE = 8 << 20, 64, 1 << 20
#: Bytes of text whose scores are put together in one partition.
BACK = 64 << 20
#: N-grams a task gathers before it sends them on; bytes of text whose probes are sent together.
GATHER, TOGETHER = 3_000_000, 4 << 20
#: A pair's probability leans on its second word's as if that had been seen so often.
LEAN = 500.0

#: In place of a level: the parts are asked for it; the word stands before a text's first.
ASKED, START = 255, 254
_END, _START = (mix64(np.array([x], np.uint64))[0] for x in (0x656E64, 0x7374617274))
#: Level i stands for counts from LEVELS[i - 1] to below LEVELS[i]: two levels for every doubling.
LEVELS = np.array(sorted({1, 2, *(2**i for i in range(2, 62)), *(3 * 2 ** (i - 1) for i in range(1, 61))}), np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, "right")


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * np.uint64(0xD6E8FEB86659FD93) + second)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, hash of the token before it, offsets of the texts' tokens); every text ends in one end token."""
    data, offsets = flat_text(column)
    data = lower_ascii(data)
    starts, ends, at = find_words(data, offsets)
    words = word_hashes(data, starts, ends)
    at = at + np.arange(len(at))
    tokens = np.full(int(at[-1]), _END, np.uint64)
    word = np.ones(len(tokens), bool)
    word[at[1:] - 1] = False
    tokens[word] = words
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[at[:-1]] = _START
    return tokens, before, at


def _totals(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with their summed counts."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    fresh = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[fresh], np.add.reduceat(counts, fresh)


def gather_counts(docs: DataFrame, segments: int) -> DataFrame:
    """(n, segment, hashes, counts): packed exact counts of 1-grams and 2-grams of docs (column text), by hash range.

    A task sends an n-gram once for each GATHER tokens it reads, so a very frequent one costs a row for each such
    stretch of text and no more.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {1: [], 2: []}

        def send() -> pa.RecordBatch:
            rows = []
            for n, parts in waiting.items():
                hashes, counts = np.unique(np.concatenate(parts), return_counts=True)
                edges = segment_edges(hashes, segments)
                rows += [(n, s, pack(hashes[edges[s] : edges[s + 1]]), pack(counts[edges[s] : edges[s + 1]].astype(np.int64))) for s in np.flatnonzero(np.diff(edges)).tolist()]
                parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["n", "segment", "hashes", "counts"])

        for batch in text_pieces(batches):
            tokens, before, _ = _tokens(batch.column(0))
            waiting[1].append(tokens)
            waiting[2].append(_pair(before, tokens))
            if sum(map(len, waiting[1])) >= GATHER:
                yield send()
        if waiting[1]:
            yield send()

    return docs.select("text").mapInArrow(sent, "n int, segment int, hashes binary, counts binary")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(n, segment, hashes, counts) of rows sorted by n and segment."""
    now, parts = None, []

    def total():
        hashes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        return (*now, *_totals(hashes, counts))

    for batch in batches:
        for n, segment, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (n, segment) != now and now is not None:
                yield total()
                parts = []
            now = (n, segment)
            parts.append((unpack(hashes, np.uint64), unpack(counts, np.int64)))
    if now is not None:
        yield total()


class LogFrequencyFilter:
    """Levels of n-grams: a Bloom filter for each hash range, each of a size of its own."""

    def __init__(self, parts: dict[int, np.ndarray], segments: int) -> None:
        sizes = np.zeros(segments, np.int64)
        sizes[list(parts)] = [len(x) for x in parts.values()]
        self.offsets = np.append(0, np.cumsum(sizes))
        self.words = np.concatenate([*(parts[s] for s in sorted(parts)), np.zeros(1, np.uint64)])
        self.segments = segments

    @staticmethod
    def _places(keys: np.ndarray, sizes: np.ndarray | np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A block of eight 64-bit words is picked once; each probe takes a word of it and a bit."""
        state = mix64(keys)
        block = ((state >> np.uint64(32)) * (sizes >> np.uint64(3)) >> np.uint64(32)) << np.uint64(3)
        bits = mix64(state)
        for i in range(PROBES):
            own = bits >> np.uint64(9 * i)
            yield block + (own & np.uint64(7)), np.uint64(1) << ((own >> np.uint64(3)) & np.uint64(63))

    @staticmethod
    def _keys(hashes: np.ndarray, level: int) -> np.ndarray:
        return hashes + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)

    @classmethod
    def part(cls, hashes: np.ndarray, levels: np.ndarray, bits: int = BITS_EACH) -> np.ndarray:
        """The filter of one hash range, ``bits`` for each entry."""
        size = (int(levels.sum()) * bits // 512 + 1) * 8
        words = np.zeros(size, np.uint64)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for at, bit in cls._places(cls._keys(hashes[levels >= level], level), np.uint64(size)):
                np.bitwise_or.at(words, at.astype(np.int64), bit)
        return words

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 if the filter does not hold it."""
        if self.segments == 1:
            part = np.zeros(len(hashes), np.int64)
        else:
            part = ((hashes >> np.uint64(32)) * np.uint64(self.segments) >> np.uint64(32)).astype(np.int64)
        base, sizes = self.offsets[part], np.diff(self.offsets)[part].astype(np.uint64)
        found = np.zeros(len(hashes), np.int64)
        left = np.flatnonzero(sizes)
        level = 1
        while len(left) and level <= len(LEVELS):
            hit = np.ones(len(left), bool)
            for at, bit in self._places(self._keys(hashes[left], level), sizes[left]):
                hit &= (self.words[base[left] + at.astype(np.int64)] & bit) != 0
            left = left[hit]
            found[left] = level
            level += 1
        return found


class Corpus:
    """What scoring needs to know of all training documents: a few numbers."""

    def __init__(self, sizes: np.ndarray, mass: np.ndarray, starts: float, lean: float) -> None:
        self.typical = np.where(sizes > 0, mass / np.maximum(sizes, 1), 0.0)  # mean count at each level of 1-grams and 2-grams
        self.train, kinds = int(mass[1].sum()), int(sizes[1].sum())
        self.total, self.lean = float(self.train + 0.5 * (kinds + 1)), lean
        self.contexts = np.zeros(START + 1)
        self.contexts[: len(LEVELS) + 1], self.contexts[START] = self.typical[1], starts

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / self.total)

    def log_model(self, first: np.ndarray, second: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """The log10 probability of each token from levels: of the token before it (or START), its own, their pair's."""
        single = (self.typical[1][second] + 0.5) / self.total
        context = self.contexts[first]
        return np.log10((np.minimum(self.typical[2][pairs], context) + self.lean * single) / (context + self.lean))


class FrequentPairs:
    """Levels of frequent pairs, one pair for each slot by hash: of those that meet in a slot, the most frequent."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, levels: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(1, (2 * len(hashes) - 1).bit_length()))
        order = np.argsort(counts, kind="stable")
        slots = (hashes[order] >> self.shift).astype(np.int64)
        self.hashes, self.held = np.zeros(1 << 64 - int(self.shift), np.uint64), np.full(1 << 64 - int(self.shift), ASKED, np.uint8)
        self.hashes[slots], self.held[slots] = hashes[order], levels[order]

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        slots = (hashes >> self.shift).astype(np.int64)
        return np.where(self.hashes[slots] == hashes, self.held[slots], np.uint8(ASKED))


class Near:
    """What every task holds of the model: exact counts of frequent words (in order) and either the whole filter or levels of frequent words and pairs."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, ones: LogFrequencyFilter | np.ndarray, pairs: LogFrequencyFilter | FrequentPairs) -> None:
        self.words, self.counts, self.ones, self.pairs = words, counts, ones, pairs
        self.whole = isinstance(ones, LogFrequencyFilter)

    def of_words(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether the count is here, the count, the level or ASKED) of each word."""
        if len(self.words):
            place = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
            known = self.words[place] == distinct
            counts = np.where(known, self.counts[place], 0)
        else:
            known, counts = np.zeros(len(distinct), bool), np.zeros(len(distinct), np.int64)
        if self.whole:
            return known, counts, self.ones.levels(distinct).astype(np.uint8)
        levels = np.full(len(distinct), ASKED, np.uint8)
        if known.any():
            levels[known] = self.ones[place[known]]
        return known, counts, levels

    def of_pairs(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each pair or ASKED."""
        if not self.whole:
            return self.pairs.levels(hashes)
        both, whose = np.unique(hashes, return_inverse=True)
        return self.pairs.levels(both).astype(np.uint8)[whose]


def _counted(batches: Iterator[pa.RecordBatch], bits: int, head: int) -> Iterator[pa.RecordBatch]:
    """The model's rows: for each hash range of n-grams its filter, and exact counts of all 1-grams and of the ``head`` most frequent 2-grams."""
    for n, segment, hashes, counts in _merged(batches):
        levels = levels_of(counts)
        size = np.bincount(levels, minlength=len(LEVELS) + 1)
        mass = np.bincount(levels, weights=counts, minlength=len(LEVELS) + 1)
        exact = np.argpartition(counts, -head)[-head:] if n == 2 and 0 < head < len(counts) else slice(None if n == 1 or head else 0)
        values = [n, segment, pack(hashes[exact]), pack(counts[exact]), LogFrequencyFilter.part(hashes, levels, bits).tobytes(), size.tolist(), mass.tolist()]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["n", "segment", "hashes", "counts", "part", "sizes", "mass"])


_ASKED = ["batch", "n", "range", "packed"]
_ASKED_SCHEMA = "batch long, n int, range long, packed binary"


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=_ASKED)


def _ranges_of(hashes: np.ndarray, segments: int, ranges: int) -> np.ndarray:
    """The range of each hash: segments go to ranges in order."""
    return (((hashes >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)) * np.uint64(ranges) // np.uint64(segments)).astype(np.uint16)


def _split(hashes: np.ndarray, at: np.ndarray, ranges: int) -> list[tuple[int, bytes]]:
    """(range, packed hashes) of hashes sorted by their ranges ``at``."""
    edges = np.searchsorted(at, np.arange(ranges + 1))
    return [(r, pack(hashes[edges[r] : edges[r + 1]])) for r in np.flatnonzero(np.diff(edges)).tolist()]


def _answered(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """Answers to probes (batch, n, range, packed): levels, and of 1-grams counts before them. Rows come by n and range, the model's rows (batch -1) first; rows of n = 0 pass."""
    now, parts, waiting, many = None, {}, [], 0
    known, words, totals = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def answer() -> pa.RecordBatch:
        n = now[0]
        hashes = np.concatenate([h for _, h in waiting])
        levels = known.levels(hashes).astype(np.uint8) if known else np.zeros(len(hashes), np.uint8)
        exact = np.zeros(len(hashes) if n == 1 else 0, np.int64)
        if n == 1 and len(words):
            place = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
            exact = np.where(words[place] == hashes, totals[place], 0)
        ends = np.cumsum([len(h) for _, h in waiting])
        starts = ends - [len(h) for _, h in waiting]
        return _rows([(b, *now, pickle.dumps((pack(exact[i:j]), pack(levels[i:j])))) for (b, _), i, j in zip(waiting, starts.tolist(), ends.tolist(), strict=True)])

    for batch in batches:
        passed = []
        for b, n, at, packed, segment, counts, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if n == 0:
                passed.append((b, n, at, packed))
                continue
            if (n, at) != now:
                if waiting:
                    yield answer()
                now, parts, waiting, many, known = (n, at), {}, [], 0, None
                words, totals = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if b < 0:
                parts[segment] = np.frombuffer(part, np.uint64), unpack(packed or b"", np.uint64), unpack(counts or b"", np.int64)
                continue
            if parts:
                known = LogFrequencyFilter({s: x[0] for s, x in parts.items()}, segments)
                words, totals = (np.concatenate([parts[s][i] for s in sorted(parts)]) for i in (1, 2))
                parts = {}
            waiting.append((b, unpack(packed, np.uint64)))
            many += len(waiting[-1][1])
            if many >= AT_ONCE:
                yield answer()
                waiting, many = [], 0
        if passed:
            yield _rows(passed)
    if waiting:
        yield answer()


def score_documents(docs: DataFrame, lean: float = LEAN, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS_EACH) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the documents that are not held out; a null id counts as the empty text (not held
    out), a null text as empty: one end token. Repeated rows each count and each give a row. Without
    training documents every word is unknown and the probabilities are those of the smoothing. Other columns are not read; an empty table
    gives no row. Words are told apart by 64-bit hashes. ``bits``: of the filter for each entry.
    """
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    given = docs.select(F.col(id_col).cast("long").alias("id"), (fold == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    learned = given.where(~F.col("held_out"))
    size = text_bytes(given)
    segments = segment_count(size, spark)
    head = HEAD_PAIRS // segments
    dealt = gather_counts(learned, segments).repartition(partition_count(segments), "n", "segment").sortWithinPartitions("n", "segment")
    model = durable(dealt.mapInArrow(lambda batches: _counted(batches, bits, head), "n int, segment int, hashes binary, counts binary, part binary, sizes array<long>, mass array<double>"))
    spectrum = model.select("n", F.octet_length("part").alias("bytes"), F.posexplode(F.arrays_zip("sizes", "mass")).alias("level", "x"))
    sizes, mass, filter_bytes = np.zeros((3, len(LEVELS) + 1)), np.zeros((3, len(LEVELS) + 1)), 0
    for r in spectrum.groupBy("n", "level").agg(F.sum("x.sizes").alias("size"), F.sum("x.mass").alias("mass"), F.sum("bytes").alias("bytes")).collect():  # a row for each n and level
        sizes[r["n"], r["level"]], mass[r["n"], r["level"]] = r["size"], r["mass"]
        filter_bytes += r["bytes"] if r["level"] == 0 else 0
    corpus = Corpus(sizes, mass, float(learned.count()), lean)
    ranges = partition_count(min(segments, max(min(parallelism(spark), FEW), filter_bytes // RANGE_BYTES)))
    shared = spark.sparkContext.broadcast(_near(model, sizes[1], segments, filter_bytes <= FILTER_BYTES))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shared.value
        number = TaskContext.get().partitionId() << 32
        for batch in text_pieces(batches, limit=PIECE_BYTES if near.whole else TOGETHER):
            tokens, before, at = _tokens(batch.column(2))
            distinct, which = np.unique(tokens, return_inverse=True)
            hashes = _pair(before, tokens)
            ends = at[:-1]
            known, counts, levels = near.of_words(distinct)
            log_base = np.where(known, corpus.log_base(counts), 0.0)
            place = (np.cumsum(~known) - 1).astype(np.int32)  # of a word among those that are asked for
            second, pairs = levels[which], near.of_pairs(hashes)
            first = np.empty_like(second)
            first[1:], first[ends] = second[:-1], START
            later = (pairs == ASKED) | (second == ASKED) | (first == ASKED)
            score = np.zeros(len(tokens))
            score[~later] = corpus.log_model(first[~later], second[~later], pairs[~later])
            tail, later = np.flatnonzero(~known[which]), np.flatnonzero(later)
            first, second, pairs = first[later], second[later], pairs[later]
            hashes = hashes[later][pairs == ASKED]
            ranged = _ranges_of(hashes, segments, ranges)
            order = np.argsort(ranged, kind="stable")
            own = {
                "ids": pickle.dumps(batch.column(0)),
                "held_out": pickle.dumps(batch.column(1)),
                "at": at,
                "n_known": np.add.reduceat(known[which].astype(np.int64), ends),
                "base": np.add.reduceat(log_base[which], ends),
                "score": np.add.reduceat(score, ends),
                "tail": np.diff(np.searchsorted(tail, at)),  # tokens of each text whose counts are asked for, and which words they are
                "which": pack(place[which[tail]]),
                "later": np.diff(np.searchsorted(later, at)),  # tokens of each text whose levels are not all known, and what is
                "levels": (first, second, pairs),
                "words": (pack(place[which[later[first == ASKED] - 1]]), pack(place[which[later[second == ASKED]]])),
                "ranges": pack(ranged),
            }
            unknown = distinct[~known]
            rows = [(number, 0, number, pickle.dumps(own))]
            rows += [(number, 1, r, packed) for r, packed in _split(unknown, _ranges_of(unknown, segments, ranges), ranges)]
            rows += [(number, 2, r, packed) for r, packed in _split(hashes[order], ranged[order], ranges)]
            yield _rows(rows)
            number += 1

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, answers = None, {1: [], 2: []}

        def scores() -> pa.RecordBatch:
            n = len(own["at"]) - 1
            counts, words = (np.concatenate([unpack(a[i], kind) for a in answers[1]]) if answers[1] else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.uint8)))
            owner, which = np.repeat(np.arange(n), own["tail"]), unpack(own["which"], np.int32)
            known = own["n_known"] + np.bincount(owner, weights=(counts > 0)[which], minlength=n).astype(np.int64)
            base = own["base"] + np.bincount(owner, weights=corpus.log_base(counts)[which], minlength=n)
            first, second, pairs = (x.copy() for x in own["levels"])
            for x, asked_for in zip((first, second), own["words"], strict=True):
                x[x == ASKED] = words[unpack(asked_for, np.int32)]
            if answers[2]:
                found = np.empty(np.count_nonzero(pairs == ASKED), np.uint8)
                found[np.argsort(unpack(own["ranges"], np.uint16), kind="stable")] = np.concatenate([unpack(a[1], np.uint8) for a in answers[2]])
                pairs[pairs == ASKED] = found
            score = own["score"] + np.bincount(np.repeat(np.arange(n), own["later"]), weights=corpus.log_model(first, second, pairs), minlength=n)
            return pa.RecordBatch.from_arrays(
                [pickle.loads(own["ids"]), pickle.loads(own["held_out"]), pa.array(np.diff(own["at"])), pa.array(known), pa.array(np.full(n, corpus.train)), pa.array(base), pa.array(score)],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for batch in batches:
            for n, packed in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if n:
                    answers[n].append(pickle.loads(packed))
                    continue
                if own is not None:
                    yield scores()
                own, answers = pickle.loads(packed), {1: [], 2: []}
        if own is not None:
            yield scores()

    # a batch's own row passes the parts with its probes: texts are read once and nothing is written but the two shuffles
    sent = given.mapInArrow(asked, _ASKED_SCHEMA)
    none = F.lit(None).cast("binary")
    exact = [F.when(F.col("n") == 1, F.col(c)) for c in ("hashes", "counts")]
    parts = model.select(F.lit(-1).cast("long").alias("batch"), "n", F.expr(f"cast(segment as bigint) * {ranges} div {segments}").alias("range"), exact[0].alias("packed"), "segment", exact[1].alias("counts"), "part")
    back = partition_count(max(parallelism(spark), size // BACK))
    met = parts.unionByName(sent.withColumns({"segment": F.lit(None).cast("int"), "counts": none, "part": none})).repartition(max(back, ranges), "n", "range").sortWithinPartitions("n", "range", "batch")
    answers = met.mapInArrow(lambda batches: _answered(batches, segments), _ASKED_SCHEMA)
    whole = answers.repartition(back, "batch").sortWithinPartitions("batch", "n", "range")
    out = whole.mapInArrow(finished, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def _frequent(model: DataFrame, n: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, levels in the filter) of n-grams of at least so many occurrences that the model has exact counts of."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, c = unpack(hashes, np.uint64), unpack(counts, np.int64)
                h, c = h[c >= least], c[c >= least]
                levels = LogFrequencyFilter({0: np.frombuffer(part, np.uint64)}, 1).levels(h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(levels.astype(np.int8))], names=["hash", "count", "level"])

    table = model.where(F.col("n") == n).select("hashes", "counts", "part").mapInArrow(frequent, "hash long, count long, level byte").toArrow()
    return table.column("hash").to_numpy().view(np.uint64), table.column("count").to_numpy(), table.column("level").to_numpy().view(np.uint8)


def _near(model: DataFrame, kinds: np.ndarray, segments: int, whole: bool) -> Near:
    """What is broadcast: HEAD_WORDS words at most (kinds: words at each level), and the whole filter (FILTER_BYTES at most) or HEAD_PAIRS pairs at most."""
    above = np.cumsum(kinds[::-1])[::-1]  # words of at least each level
    level = int(np.flatnonzero(above <= HEAD_WORDS)[0]) if (above <= HEAD_WORDS).any() else len(LEVELS)
    words, counts, levels = _frequent(model, 1, int(LEVELS[level - 1]) if level else 1)
    order = np.argsort(words)
    if not whole:
        return Near(words[order], counts[order], levels[order], FrequentPairs(*_frequent(model, 2, 1)))
    parts: dict[int, dict[int, np.ndarray]] = {1: {}, 2: {}}
    for r in model.select("n", "segment", "part").toLocalIterator(prefetchPartitions=True):
        parts[r["n"]][r["segment"]] = np.frombuffer(r["part"], np.uint64)
    return Near(words[order], counts[order], LogFrequencyFilter(parts[1], segments), LogFrequencyFilter(parts[2], segments))


def op8_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
