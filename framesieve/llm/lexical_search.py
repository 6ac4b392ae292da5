"""Ranked lexical search (operator 12) with hashed max-sketches.

A document's sketch has a power of two of coordinates, at least ``LOAD`` for each of its distinct terms. Each term's impact (its
part of the score without the term's weight) is folded into the coordinate that the leading bits of its hash pick, as the
maximum there; so what a sketch holds for a term is never below the term's impact in the document, and mostly equal to it.

1. One pass counts N, L and each query term's df; they leave as sums by term.
2. In the second pass a batch's documents are sketched, and the terms of all queries are looked up in all sketches at once; weighted sums
   are upper bounds of the scores. A query's documents are scored exactly in descending order of their bounds until the next bound is below the query's
   k-th score so far, which its task carries from batch to batch. Only documents that are scored have their terms read again.
3. Each task gives k rows a query; they meet by query and a salt, then by query.

Queries go to all tasks in blocks of bounded size. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framesieve.llm.common import find_words, flat_text, lower_ascii, small_batches, text_bytes, text_pieces, word_hashes

#: Results of a query, coordinates of a sketch for each distinct term, bytes of queries in a block, documents scored in a first round, salts of the last step.
TOP, LOAD, BLOCK_BYTES, FIRST, SALTS = 10, 8, 1 << 20, 16, 64
#: Rows of a document table whose bounds are held at once, times the query terms of a block.
BOUND_CELLS = 4_000_000

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_NULL_ID = np.iinfo(np.int64).max


@dataclass
class _Terms:
    """The distinct terms of some texts in order of text and hash: their texts, hashes and occurrences; edges of each text's terms; terms of each text with repeats."""

    owner: np.ndarray
    hashes: np.ndarray
    tf: np.ndarray
    edges: np.ndarray
    n: np.ndarray


def _terms(column: pa.Array) -> _Terms:
    data, offsets = flat_text(column)
    data = lower_ascii(data)
    starts, ends, at = find_words(data, offsets, _SEPARATOR)
    hashes = word_hashes(data, starts, ends)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort([hashes, owner])
    hashes = hashes[order]
    fresh = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    return _Terms(owner[fresh], hashes[fresh], np.diff(np.append(fresh, len(hashes))), np.searchsorted(owner[fresh], np.arange(len(n) + 1)), n)


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class _Queries:
    """A block of queries: item ids; for each query its terms (places in ``vocabulary``, sorted hashes) with repeats."""

    ids: list
    vocabulary: np.ndarray
    edges: np.ndarray
    places: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: pa.Array) -> _Queries:
        own = _terms(texts)
        vocabulary, places = np.unique(own.hashes, return_inverse=True)
        return cls(ids, vocabulary, own.edges, places, own.tf)


class Sketches:
    """Max-sketches of the impacts of some documents."""

    def __init__(self, terms: _Terms, impacts: np.ndarray) -> None:
        distinct = np.diff(terms.edges)
        self.bits = np.ceil(np.log2(np.maximum(LOAD * distinct, 2))).astype(np.uint64)
        sizes = np.int64(1) << self.bits.astype(np.int64)
        self.starts = np.append(0, np.cumsum(sizes))
        self.values = np.zeros(int(self.starts[-1]), np.int64)
        place = self.starts[terms.owner] + (terms.hashes >> (np.uint64(64) - self.bits[terms.owner])).astype(np.int64)
        fresh = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)  # hashes ascend, so places do
        if len(fresh):
            self.values[place[fresh]] = np.maximum.reduceat(impacts, fresh)

    def bounds(self, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """For each row and hash a number not below the impact of the hash's term in the document."""
        return self.values[self.starts[rows][:, None] + (hashes[None, :] >> (np.uint64(64) - self.bits[rows][:, None])).astype(np.int64)]


class _Best:
    """The ``k`` best documents of each query so far, by score and then id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor = k, np.ones(queries, np.int64)
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = score > 0
        q, s, i = (np.append(x, y[good]) for x, y in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort([i, -s, q])
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.query, self.score, self.id = q[kept], s[kept], i[kept]
        full = place == self.k - 1
        self.floor[q[full]] = s[full]


def _search_batch(ids: np.ndarray, terms: _Terms, m: np.ndarray, queries: _Queries, weights: np.ndarray, best: _Best) -> None:
    """Adds a batch's documents to the best of each query. weights: of the queries' terms, repeats counted."""
    rows = np.flatnonzero(terms.n)
    if not len(rows) or not len(queries.places):
        return
    sketches = Sketches(terms, _impact(terms.tf, m[terms.owner]))
    asked = np.flatnonzero(np.diff(queries.edges))
    step = max(1, BOUND_CELLS // len(queries.places))
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        looked = sketches.bounds(part, queries.vocabulary)[:, queries.places]
        bound = np.zeros((len(part), len(queries.ids)), np.int64)
        bound[:, asked] = np.add.reduceat(looked * weights, queries.edges[asked], axis=1)
        d, q = np.nonzero(bound >= best.floor)
        b = bound[d, q]
        order = np.lexsort([-b, q])
        d, q, b = part[d[order]], q[order], b[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        low, high = 0, FIRST
        while len(q):
            now = (place < high) & (place >= low) & (b >= best.floor[q])
            if now.any():
                best.add(q[now], _scores(d[now], q[now], terms, m, queries, weights), ids[d[now]])
            low, high = high, 2 * high
            left = (place >= low) & (b >= best.floor[q])
            d, q, b, place = d[left], q[left], b[left], place[left]


def _scores(d: np.ndarray, q: np.ndarray, terms: _Terms, m: np.ndarray, queries: _Queries, weights: np.ndarray) -> np.ndarray:
    """Exact scores of pairs of a document and a query."""
    docs, row = np.unique(d, return_inverse=True)
    size = np.diff(terms.edges)[docs]
    own = np.repeat(terms.edges[docs] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
    at = np.minimum(np.searchsorted(queries.vocabulary, terms.hashes[own]), len(queries.vocabulary) - 1)
    hit = queries.vocabulary[at] == terms.hashes[own]
    held = np.repeat(np.arange(len(docs)), size)[hit] * len(queries.vocabulary) + at[hit]  # ascending
    impact = _impact(terms.tf[own[hit]], m[docs][np.repeat(np.arange(len(docs)), size)[hit]])
    asked = np.diff(queries.edges)[q]
    term = np.repeat(queries.edges[q] - np.append(0, np.cumsum(asked)[:-1]), asked) + np.arange(asked.sum())
    key = np.repeat(row, asked) * len(queries.vocabulary) + queries.places[term]
    if not len(held):
        return np.zeros(len(d), np.int64)
    found = np.minimum(np.searchsorted(held, key), len(held) - 1)
    part = np.where(held[found] == key, impact[found] * weights[term], 0)
    sums = np.append(0, np.cumsum(part))
    ends = np.cumsum(asked)
    return sums[ends] - sums[ends - asked]


def _counts(docs: DataFrame, queries: _Queries) -> tuple[int, int, np.ndarray]:
    """(documents with a term, their terms with repeats, documents that hold each term of ``queries``)."""
    sent = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        df, documents, length = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in text_pieces(batches):
            terms = _terms(batch.column(1))
            documents, length = documents + int((terms.n > 0).sum()), length + int(terms.n.sum())
            if len(vocabulary):
                at = np.minimum(np.searchsorted(vocabulary, terms.hashes), len(vocabulary) - 1)
                df += np.bincount(at[vocabulary[at] == terms.hashes], minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-2, -1], seen)), pa.array(np.append([documents, length], df[seen]))], names=["term", "n"])

    sums = {r.term: r.n for r in docs.mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row a query term
    return sums.get(-2, 0), sums.get(-1, 0), np.array([sums.get(i, 0) for i in range(len(queries.vocabulary))], np.int64)


def _block(docs: DataFrame, queries: _Queries, k: int) -> DataFrame:
    documents, length, df = _counts(docs, queries)
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)[queries.places] * queries.times
    sent = docs.sparkSession.sparkContext.broadcast((queries, weights))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = sent.value
        best = _Best(len(queries.ids), k)
        for batch in text_pieces(batches):
            terms = _terms(batch.column(1))
            m = 100 - 75 + 75 * terms.n * documents // max(length, 1)
            ids = batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            _search_batch(ids, terms, m, queries, weights, best)
        none = best.id == _NULL_ID
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.query, pa.int32()), pa.array([queries.ids[i] for i in best.query.tolist()], pa.int64()), pa.array(best.id, pa.int64(), mask=none), pa.array(best.score)], names=["query", "item", "doc", "score"]
        )

    return docs.mapInArrow(found, "query int, item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, id, score): the ``k`` documents of highest score above 0 for each item, equal scores by ascending id.

    Terms are runs of letters and digits (all signs beyond ASCII are letters), A-Z lower-cased. Null and empty texts have no terms. Null ids of documents come last
    among equal scores; documents of equal id are documents of their own. Every row of ``items`` is an item, so repeated rows
    each have a result; their ids may be null. Other columns are not read; an empty table gives no row.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    blocks = max(1, -(-text_bytes(asked) // block_bytes))
    out = None
    for i in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i).toArrow() if blocks > 1 else asked.toArrow()  # about block_bytes of text
        found = _block(given, _Queries.of(own.column(0).to_pylist(), own.column(1)), k).withColumn("block", F.lit(i))
        out = found if out is None else out.union(found)
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    salted = out.withColumn("salt", F.spark_partition_id() % SALTS)
    place = F.row_number().over(W.partitionBy("block", "query", "salt").orderBy(*order))
    few = salted.withColumn("place", place).where(F.col("place") <= k)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("block", "query").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same by scoring every document that shares a term, for DuckDB.
ORACLE = r"""
WITH words AS (
  SELECT d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)
), asked AS (
  SELECT q, item_id, term, count(*) AS times FROM (
    SELECT q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)
  ) GROUP BY q, item_id, term
), totals AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS l FROM words WHERE len(w) > 0
), tf AS (
  SELECT d, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT d, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY d, doc_id, n, term
), df AS (
  SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, totals
), impacts AS (
  SELECT d, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // l)) AS impact FROM tf, totals
), scores AS (
  SELECT q, item_id, d, doc_id, sum(times * w * impact)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY q, item_id, d, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 10
"""
