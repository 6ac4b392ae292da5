"""Byte-level BPE (operator 3): pre-tokenising by class arrays and transition-function scans, cached merges, decoding.

The pattern that splits text (contractions, runs of letters, numbers or other signs with at most
one space before them, runs of white space) is written as an automaton of eight states over
symbols that look at most three code points ahead. Each symbol is a function from states to
states; functions under composition form a small monoid, so the state before every code point
comes from a prefix scan in that monoid, and a table says where a token starts.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesieve.llm.common import flat_text, map_whole, small_batches, text_pieces, unused

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Symbols: the classes above with white space told apart by what follows, and apostrophes that open a contraction.
S_LETTER, S_NUMBER, S_OTHER, S_BLANK_LAST, S_SPACE_LAST, S_SPACE_MORE, S_SHORT, S_LONG = range(8)
#: States: nothing open, a run of each class, a blank that waits for its run, white space, letters of a contraction to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, BLANK, IN_SPACE, TWO_MORE, ONE_MORE = range(8)

#: Merge results kept per worker, and the longest slice kept, in bytes.
CACHE_SLICES, CACHE_BYTES = 200_000, 48


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a token starts at this symbol)."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FRESH, False
    sign = symbol in (S_OTHER, S_SHORT, S_LONG)
    if (state, symbol) in ((IN_LETTERS, S_LETTER), (BLANK, S_LETTER)):
        return IN_LETTERS, False
    if (state, symbol) in ((IN_NUMBERS, S_NUMBER), (BLANK, S_NUMBER)):
        return IN_NUMBERS, False
    if sign and state in (IN_OTHERS, BLANK):
        return IN_OTHERS, False
    if state == IN_SPACE and symbol == S_SPACE_MORE:
        return IN_SPACE, False
    opens = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS, S_BLANK_LAST: BLANK, S_SPACE_LAST: FRESH, S_SPACE_MORE: IN_SPACE, S_SHORT: ONE_MORE, S_LONG: TWO_MORE}
    return opens[symbol], True


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, of each symbol that starts a text, composition table, state that each element gives from FRESH).

    Symbols that start a text act as if the state before were FRESH.
    """
    plain = [tuple(_step(s, x)[0] for s in range(8)) for x in range(8)]
    first = [(f[FRESH],) * 8 for f in plain]
    elements = dict.fromkeys([tuple(range(8)), *plain, *first])
    while True:
        more = {tuple(g[s] for s in f) for f in elements for g in (*plain, *first)} - elements.keys()
        if not more:
            break
        elements.update(dict.fromkeys(sorted(more)))
    index = {f: i for i, f in enumerate(elements)}
    table = np.array([[index[tuple(g[s] for s in f)] for g in elements] for f in elements], np.uint16)
    return np.array([index[f] for f in plain], np.uint16), np.array([index[f] for f in first], np.uint16), table, np.array([f[FRESH] for f in elements], np.uint8)


@cache
def _starts_token() -> np.ndarray:
    return np.array([[_step(s, x)[1] for x in range(8)] for s in range(8)])


@cache
def code_point_classes() -> np.ndarray:
    """The class of every code point, by the Unicode release that the tokeniser's own library knows.

    An encoder whose pattern is one class and whose tokens are single bytes leaves out all other code
    points, so what it gives back of all code points is the class. (Surrogates are in no text.)
    """
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    classes = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        encoder = tiktoken.Encoding(f"class {pattern}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        classes[np.frombuffer(bytes(encoder.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    return classes


def _scan(elements: np.ndarray, table: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive prefix products in the monoid: within blocks side by side, over the blocks' totals, then joined."""
    n = len(elements)
    if n <= block:
        out = elements.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    rows = -(-n // block)
    grid = np.zeros((block, rows), np.uint16)  # element 0 is the identity
    padded = np.zeros(rows * block, np.uint16)
    padded[:n] = elements
    grid[:] = padded.reshape(rows, block).T
    width, flat = table.shape[0], table.ravel()
    for i in range(1, block):
        grid[i] = flat[grid[i - 1].astype(np.int32) * width + grid[i]]
    before = np.zeros(rows, np.uint16)
    before[1:] = _scan(grid[-1], table, block)[:-1]
    return flat[before.astype(np.int32) * width + grid].T.reshape(-1)[:n]


def token_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where tokens start, as indices into ``points`` (the code points of all texts); ``text_starts``: where texts start."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    classes = code_point_classes()[points]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    last = first[1:]
    space = classes == SPACE
    before_word = np.zeros(n, bool)
    before_word[:-1] = ~space[1:]
    before_word &= ~last
    symbols = classes.copy()
    symbols[space] = S_SPACE_MORE
    symbols[space & before_word] = S_SPACE_LAST
    symbols[space & before_word & (points == 0x20)] = S_BLANK_LAST
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        ends = np.flatnonzero(last)
        end = ends[np.searchsorted(ends, quotes)]
        one = np.where(quotes + 1 <= end, points[np.minimum(quotes + 1, n - 1)], 0)
        two = np.where(quotes + 2 <= end, points[np.minimum(quotes + 2, n - 1)], 0)
        symbols[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        pair = (one << 8) | two
        symbols[quotes[np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]) & (two < 256)]] = S_LONG
    plain, opening, table, from_fresh = _monoid()
    elements = plain[symbols]
    elements[first[:-1]] = opening[symbols[first[:-1]]]
    after = from_fresh[_scan(elements, table)]
    state = np.empty(n, np.uint8)
    state[0] = FRESH
    state[1:] = after[:-1]
    state[first[:-1]] = FRESH
    return np.flatnonzero(_starts_token()[state, symbols])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one slice: the pair of lowest rank (leftmost first) is merged until none is left."""
    return _merge_short(piece, ranks) if len(piece) <= 64 else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """With the rank of every adjacent pair in a list; a merge changes two of them."""
    rank_of, none = ranks.get, 1 << 40
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [rank_of(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != none:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = rank_of(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = rank_of(parts[i] + parts[i + 1], none)
    return [ranks[x] for x in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """With a heap over a linked list: n log n for slices of any length."""
    n = len(piece)
    after, before, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), bytearray(b"\1") * n
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop or end[i] != j:
            continue
        alive[j] = 0
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (rank := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (rank, i, end[after[i]]))
        if (k := before[i]) >= 0 and (rank := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (rank, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class ByteBPE:
    """Encoder and decoder for a file of base64 tokens and ranks, one of each to a line."""

    _loaded: dict[str, ByteBPE] = {}

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.lengths = np.zeros(max(self.tokens, default=0) + 1, np.int64)
        self.lengths[list(self.tokens)] = [len(token) for token in self.tokens.values()]
        self.cache: dict[bytes, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str) -> ByteBPE:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def slice_ids(self, piece: bytes) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            rank = self.ranks.get(piece)
            ids = (rank,) if rank is not None else tuple(merge(piece, self.ranks))
            if len(piece) <= CACHE_BYTES:
                if len(self.cache) >= CACHE_SLICES:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def encode(self, column: pa.Array) -> Iterator[tuple[list[int], np.ndarray]]:
        """For each text its ids and the byte offsets of its slices."""
        data, offsets = flat_text(column)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        at_byte = np.flatnonzero((data & 0xC0) != 0x80)  # byte at which each code point starts
        texts = np.searchsorted(at_byte, offsets)
        starts = token_starts(points, np.unique(texts[:-1][offsets[1:] > offsets[:-1]]))
        cuts = np.append(at_byte[starts], len(raw))
        at = np.searchsorted(cuts[:-1], offsets)
        known, look = self.cache, self.slice_ids
        for i in range(len(offsets) - 1):
            own = cuts[at[i] : at[i + 1] + 1] if offsets[i + 1] > offsets[i] else cuts[:0]
            bounds, ids = own.tolist(), []
            for s, e in zip(bounds, bounds[1:], strict=False):
                piece = raw[s:e]
                ids += known.get(piece) or look(piece)
            yield ids, own - offsets[i]

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Where each token starts in the text's bytes; the text's length last."""
        return np.append(0, np.cumsum(self.lengths[np.asarray(ids, np.int64)]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_part(self, ids: list[int], offsets: np.ndarray, start: int, end: int) -> bytes:
        """Bytes ``start`` to ``end`` of the text, from the tokens that reach into them alone; offsets as ``offsets`` gives them."""
        first, last = max(int(np.searchsorted(offsets, start, "right")) - 1, 0), int(np.searchsorted(offsets, end))
        return self.decode(ids[first:last])[start - int(offsets[first]) : end - int(offsets[first])] if end > start else b""


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_documents(docs: DataFrame, ranks: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array of int), ``token_offsets`` (array of int: the byte at which each token starts, the
    text's length last) and ``decoded`` (the bytes that decoding gives back) added.

    A null text is encoded as the empty one: no ids, one offset (0), no bytes. All columns of ``docs`` stay; where one has such a
    name already, the new column gets underscores behind it. Repeated rows each give a row; an empty table gives none. Texts of any
    length are encoded whole. Nothing is shuffled.
    """
    path = ranks or default_ranks()
    names = unused(["token_ids", "token_offsets", "decoded"], docs.columns)
    at = docs.columns.index(text_col)
    added = [T.StructField(n, kind) for n, kind in zip(names, (T.ArrayType(T.IntegerType()), T.ArrayType(T.IntegerType()), T.BinaryType()), strict=True)]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        bpe = ByteBPE.load(path)
        for batch in text_pieces(batches, f"c{at}"):
            ids = [own for own, _ in bpe.encode(batch.column(at))]
            more = [pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.offsets(own) for own in ids], pa.list_(pa.int32())), pa.array([bpe.decode(own) for own in ids], pa.binary())]
            yield [*batch.columns, *more]

    return map_whole(docs, encoded, added)


def token_digests(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, and SHA-256 of its ids (decimal, joined by blanks) and of the decoded bytes.

    Null texts, repeated rows and empty tables as in ``encode_documents``; other columns are not read.
    """
    path = ranks or default_ranks()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.load(path)
        for batch in text_pieces(batches):
            counts, ids_sha, decoded_sha = [], [], []
            for ids, _ in bpe.encode(batch.column(1)):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = given.mapInArrow(digests, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
