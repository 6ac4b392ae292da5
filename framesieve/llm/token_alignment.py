"""Alignment of two tokenisers' tokens (operator 11) with an identity map as the fast path.

Both tokenisers start a token at a single space between two signs that are no white space, so a text is cut there and
each new piece is encoded and aligned once a worker; a text's alignment is that of its pieces, one behind another.

1. The table ``same`` gives for each token of A the token of B of the same bytes. A group of one A token and the B token that
   ``same`` gives it is counted at A's place in a vector as long as A's vocabulary; only the links of other groups are
   counted as pairs. Both leave a task as sums.
2. Of the pairs' counts, those of the ``same`` pairs, the highest of each B token and the most frequent other pairs
   (by the pigeonhole principle at most HEAVY) go to all tasks: their number is bounded by the vocabularies. A text's links of
   other pairs meet their counts in an equi-join, in which no key holds more than one in HEAVY of all links.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.llm.common import durable, flat_text, pack, small_batches, text_pieces, unpack

#: Pieces kept per worker and their characters; characters of one call of the libraries; pairs a task holds before it sends their counts.
CACHE_PIECES, CACHE_CHARS, CALL_CHARS, HELD_PAIRS = 600_000, 12 << 20, 1 << 19, 1_000_000
#: A pair of more than one in HEAVY of all links is known to every task, so at most HEAVY pairs are.
HEAVY = 1 << 18

_SAFE = re.compile(r"(?<=\S)(?= \S)")
_workers: dict[tuple[str, str], _Aligner] = {}


def _byte_of_sign() -> dict[str, int]:
    """The bytes behind the signs of a byte-level vocabulary: printable Latin-1 signs are themselves, others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class _Aligner:
    """Both tokenisers and what is known of pieces, one a worker."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        signs = _byte_of_sign()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(signs[c] for c in entry) if all(c in signs for c in entry) else entry.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.size_b = len(self.bytes_b)
        self.same = np.full(len(self.bytes_a), -1, np.int64)
        by_bytes: dict[bytes, int] = {}
        for i, entry in enumerate(self.bytes_b):
            if not (self.b.is_control(i) or self.b.is_unknown(i)) and (entry not in by_bytes or self.b.is_byte(by_bytes[entry])):
                by_bytes[entry] = i  # a piece of its own before the fallback of its byte
        for i, entry in enumerate(self.bytes_a):
            self.same[i] = by_bytes.get(entry, -1)
        self.size_a, self.lengths_a, self.lengths_b = len(self.bytes_a), np.array([*map(len, self.bytes_a)]), np.array([*map(len, self.bytes_b)])
        self.clear()

    def clear(self) -> None:
        """Forgets all pieces. Of each piece by its number: its groups as text, numbers of tokens and groups, whether both tokenisers give back its bytes; its links, packed as
        a * |B| + b, and which of them are in ``same``, from its edge on."""
        self.known: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.sizes, self.whole = np.zeros((0, 3), np.int64), np.zeros(0, bool)
        self.pairs, self.plain, self.edges = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Encodes and aligns pieces. Every token has a byte at least, so one A and one B token end at each shared offset."""
        tokens_a = [x.ids for x in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        tokens_b = self.b.encode([piece[1:] for piece in pieces], num_threads=1)
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (tokens_a, tokens_b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(pieces)) for x in (tokens_a, tokens_b))
        raw = [piece.encode() for piece in pieces]
        whole = np.ones(len(pieces), bool)
        joined_a, joined_b = b"".join(map(self.bytes_a.__getitem__, a.tolist())), b"".join(map(self.bytes_b.__getitem__, b.tolist()))
        if not joined_a == joined_b == b"".join(raw):
            whole[:] = [b"".join(self.bytes_a[i] for i in x) == r == b"".join(self.bytes_b[i] for i in y) for x, y, r in zip(tokens_a, tokens_b, raw, strict=True)]
            a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
            n_a, n_b = n_a * whole, n_b * whole
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        cuts_a, cuts_b = np.flatnonzero(np.isin(ends_a, ends_b, assume_unique=True)), np.flatnonzero(np.isin(ends_b, ends_a, assume_unique=True))
        pairs = a[cuts_a] * self.size_b + b[cuts_b]
        plain = (np.diff(cuts_a, prepend=-1) == 1) & (np.diff(cuts_b, prepend=-1) == 1) & (self.same[a[cuts_a]] == b[cuts_b])
        n_groups = np.diff(np.searchsorted(cuts_a, np.append(0, np.cumsum(n_a))))
        # both sides' tokens in one row, group by group, each before the sign that follows it
        before = np.append(-1, cuts_b)[np.searchsorted(cuts_a, np.arange(len(a)))] + 1
        through = np.append(cuts_a, len(a) - 1)[np.searchsorted(cuts_b, np.arange(len(b)))] + 1
        row, signs = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int8)
        at_a, at_b = np.arange(len(a)) + before, np.arange(len(b)) + through
        row[at_a], row[at_b] = a, b
        signs[at_a[cuts_a]], signs[at_b[cuts_b]] = 1, 2
        text = pc.binary_join_element_wise(pa.array(row).cast(pa.string()), pa.array([",", "|", ";"]).take(pa.array(signs)), "")
        data, offsets = flat_text(text)
        data = data.tobytes().decode("ascii")
        bounds = offsets[np.append(0, np.cumsum(n_a + n_b))].tolist()
        self.known.update(zip(pieces, range(len(self.groups), len(self.groups) + len(pieces)), strict=True))
        self.groups += [data[s : e - 1] for s, e in zip(bounds, bounds[1:], strict=False)]
        self.chars += sum(map(len, pieces))
        self.sizes, self.whole = np.concatenate([self.sizes, np.stack([n_a, n_b, n_groups], axis=1)]), np.append(self.whole, whole)
        self.pairs, self.plain, self.edges = np.append(self.pairs, pairs), np.append(self.plain, plain), np.append(self.edges, self.edges[-1] + np.cumsum(n_groups))

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts' pieces, edges of each text's). A text without tokens has none. Numbers hold until the next call."""
        cut = [_SAFE.split(f" {text}") if text else [] for text in texts]
        if len(self.known) > CACHE_PIECES or self.chars > CACHE_CHARS:
            self.clear()
        fresh = list({piece for own in cut for piece in own if piece not in self.known})
        at = 0
        while at < len(fresh):
            to, chars = at, 0
            while to < len(fresh) and chars < CALL_CHARS:
                chars += len(fresh[to])
                to += 1
            self._learn(fresh[at:to])
            at = to
        known = self.known
        numbers = np.fromiter((known[piece] for own in cut for piece in own), np.int64)
        edges = np.append(0, np.cumsum([*map(len, cut)])).astype(np.int64)
        if not self.whole[numbers].all():
            bad = np.unique(np.searchsorted(edges, np.flatnonzero(~self.whole[numbers]), "right") - 1)
            size = np.diff(edges)
            size[bad], left = 0, np.repeat(~np.isin(np.arange(len(cut)), bad), size)
            numbers, edges = numbers[left], np.append(0, np.cumsum(size))
        return numbers, edges

    def totals(self, numbers: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """(tokens of A, of B, groups) of each text."""
        return np.diff(np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(self.sizes[numbers], axis=0)])[edges], axis=0)

    def texts(self, numbers: np.ndarray, edges: np.ndarray) -> list[str]:
        """Each text's groups."""
        own = [self.groups[i] for i in numbers.tolist()]
        return [";".join(own[s:e]) for s, e in zip(edges.tolist(), edges[1:].tolist(), strict=False)]

    def links(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``pairs`` of the links of pieces, which of ``numbers`` each belongs to)."""
        start, size = self.edges[numbers], np.diff(self.edges)[numbers]
        return np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum()), np.repeat(np.arange(len(numbers)), size)


def _aligner(path_a: str, path_b: str) -> _Aligner:
    if (path_a, path_b) not in _workers:
        _workers[path_a, path_b] = _Aligner(path_a, path_b)
    return _workers[path_a, path_b]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align_texts(docs: DataFrame, tokenizers: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, groups): each text's tokens of A and B in groups that end at the same byte, as ``a1,a2|b1;a3|b2,b3``.

    The texts are encoded with a space before them. Null and empty texts, and texts whose bytes either tokeniser does not give back, have no
    tokens: zeros and an empty string. Null ids stay, repeated rows each give a row, other columns are not read, an empty table gives no row. Nothing is shuffled.
    """
    paths = tokenizers or default_tokenizers()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*paths)
        for batch in text_pieces(batches):
            numbers, edges = aligner.pieces(batch.column(1).to_pylist())
            totals = aligner.totals(numbers, edges)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(totals[:, i]) for i in range(3)), pa.array(aligner.texts(numbers, edges), pa.string())], names=["id", "n_a", "n_b", "n_groups", "groups"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(aligned, "id long, n_a long, n_b long, n_groups long, groups string").withColumnRenamed("id", id_col)


@dataclass
class _Held:
    """What a task has counted: the vector of ``same`` pairs, and other pairs."""

    vector: np.ndarray
    packed: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)

    def add(self, aligner: _Aligner, numbers: np.ndarray) -> None:
        own, times = np.unique(numbers, return_counts=True)
        at, of = aligner.links(own)
        pairs, times, plain = aligner.pairs[at], times[of], aligner.plain[at]
        self.vector += np.bincount(pairs[plain] // aligner.size_b, times[plain], len(self.vector)).astype(np.int64)
        rest, place = np.unique(pairs[~plain], return_inverse=True)
        self.packed.append(rest)
        self.counts.append(np.bincount(place, times[~plain], len(rest)).astype(np.int64))

    def sent(self) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(np.concatenate([*self.packed, np.zeros(0, np.int64)]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([*self.counts, np.zeros(0, np.int64)]), len(own)).astype(np.int64)
        self.packed, self.counts = [], []
        return own, sums


def _linked(docs: DataFrame, paths: tuple[str, str], id_col: str, text_col: str) -> DataFrame:
    """A row for each text (id, n_a, n_b, n_groups, groups_sha256, its links packed and compressed), and rows of (pair, n) that count links, each of a task."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, codec = _aligner(*paths), pa.Codec("zstd", 1)
        held = _Held(np.zeros(len(aligner.same), np.int64))

        def counts(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            none = [pa.nulls(len(pair), kind) for kind in (*[pa.int64()] * 4, pa.string(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(pair), pa.array(n)], names=_LINKED_NAMES)

        for batch in text_pieces(batches):
            numbers, edges = aligner.pieces(batch.column(1).to_pylist())
            held.add(aligner, numbers)
            totals, groups = aligner.totals(numbers, edges), aligner.texts(numbers, edges)
            at, of = aligner.links(numbers)
            flat, bounds = aligner.pairs[at], np.searchsorted(of, edges).tolist()
            packed = [codec.compress(pack(flat[s:e]), asbytes=True) if e > s else b"" for s, e in zip(bounds, bounds[1:], strict=False)]
            none = pa.nulls(len(packed), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(totals[:, i]) for i in range(3)), pa.array([sha256(x.encode()).hexdigest() if x else "" for x in groups], pa.string()), pa.array(packed, pa.binary()), none, none], names=_LINKED_NAMES
            )
            if sum(map(len, held.packed)) > HELD_PAIRS:
                yield counts(*held.sent())
        yield counts(*held.sent())
        seen = np.flatnonzero(held.vector)
        yield counts(seen * aligner.size_b + aligner.same[seen], held.vector[seen])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(linked, "id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pair long, n long")


_LINKED_NAMES = ["id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "pair", "n"]


def _size_b(paths: tuple[str, str]) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()


def _summed(linked: DataFrame) -> DataFrame:
    return linked.where(F.col("n").isNotNull()).groupBy("pair").agg(F.sum("n").alias("count"))


def count_links(docs: DataFrame, tokenizers: tuple[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """(a, b, count): how many links of all texts hold the tokens a of A and b of B.

    A link is an A and a B token that end at the same byte of a text. Texts without tokens (see ``align_texts``) have none; an empty table gives no row.
    """
    paths = tokenizers or default_tokenizers()
    size_b = _size_b(paths)
    sums = _summed(_linked(docs.withColumn("_none", F.lit(None).cast("long")), paths, "_none", text_col))
    return sums.select(F.expr(f"pair div {size_b}").cast("int").alias("a"), (F.col("pair") % size_b).cast("int").alias("b"), "count")


def align_corpus(docs: DataFrame, tokenizers: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, by the counts of links in all texts (``count_links``).

    n_best: links whose count is the highest that their B token has with any A token, ties included; count_sum: the counts of all links. Every text is encoded once; its
    links are kept, compressed, until the counts are there. Other cases as in ``align_texts``.
    """
    spark = docs.sparkSession
    paths = tokenizers or default_tokenizers()
    size_b = _size_b(paths)
    linked = durable(_linked(docs, paths, id_col, text_col))
    counts = durable(_summed(linked).withColumn("b", F.col("pair") % size_b))
    best = counts.groupBy("b").agg(F.max("count").alias("best"))
    highest = np.zeros(size_b, np.int64)
    for row in best.toLocalIterator():  # one row a token of B
        highest[row.b] = row.best
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    heavy = F.col("count") > total // HEAVY
    rows = counts.where(heavy).select("pair", "count").toArrow()  # fewer than HEAVY rows
    order = np.argsort(rows.column(0).to_numpy())
    sent = spark.sparkContext.broadcast((highest, np.append(rows.column(0).to_numpy()[order], -1), np.append(rows.column(1).to_numpy()[order], 0)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        highest, pairs, known = sent.value
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            own = [unpack(codec.decompress(x, 8 * n, asbytes=True), np.int64) for x, n in zip(batch.column(5).to_pylist(), sizes.tolist(), strict=True) if n]
            flat, of = np.concatenate([*own, np.zeros(0, np.int64)]), np.repeat(np.arange(len(sizes)), sizes)
            distinct, back = np.unique(flat, return_inverse=True)
            place = np.searchsorted(pairs[:-1], distinct)
            there = pairs[place] == distinct
            count = np.where(there, known[place], 0)
            best = there & (count == highest[distinct % size_b])
            sums = [np.diff(np.append(0, np.cumsum(x[back].astype(np.int64)))[np.append(0, np.cumsum(sizes))]) for x in (best, count)]
            rare = ~there[back]
            met, times = np.unique(np.stack([of[rare], flat[rare]], axis=1), axis=0, return_counts=True)
            bounds = pa.array(np.searchsorted(met[:, 0], np.arange(len(sizes) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], batch.column(3), *(pa.array(x, pa.int64()) for x in sums), batch.column(4), pa.ListArray.from_arrays(bounds, pa.array(met[:, 1])), pa.ListArray.from_arrays(bounds, pa.array(times))],
                names=["id", "n_a", "n_b", "n_groups", "n_links", "best", "sum", "groups_sha256", "pair", "times"],
            )

    texts = linked.where(F.col("n").isNull()).select(*_LINKED_NAMES[:6])
    made = texts.mapInArrow(scored, "id long, n_a long, n_b long, n_groups long, n_links long, best long, sum long, groups_sha256 string, pair array<long>, times array<long>")
    made = durable(made.withColumn("row", F.monotonically_increasing_id()))
    rare = made.select("row", F.explode(F.arrays_zip("pair", "times")).alias("x")).select("row", "x.pair", "x.times")
    others = counts.where(~heavy).join(best, "b").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    met = rare.join(others, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("is_best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more"))
    return made.join(met, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256"
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return align_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
