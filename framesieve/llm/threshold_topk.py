"""Exact top-k search (operator 9) by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks. A task sorts its block by every dimension once; queries stream past it in batches. A
query reads all lists from its good end in step, scores what it sees in full, and stops once the best score that an unseen
vector could reach is below its k-th. First every query meets one block only; its k-th score there is a floor for
all other blocks, where a query stops, perhaps before it has scored anything, once the bound is below that floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framesieve.llm.common import durable, parallelism, partition_count, small_batches

TOP, SCALE, EVERY = 20, 64, 20
#: Vectors in a block, and how deep the lists are read at first (doubled each time).
BLOCK, DEPTH = 16_384, 32
#: List entries read, as a multiple of the block's vectors, after which a query scores the rest of the block without lists.
MOST_READS = 4
_NO_FLOOR = -(1 << 62)


def _search(vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, rows, how many were scored): the k vectors of highest inner product with ``query``, ties to smaller ids.

    Row ``own`` (none if negative) stays out, and so do scores below ``floor``. lists: for each dimension the rows by descending value.
    """
    n = len(vectors)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    seen = np.zeros(n, bool)
    if own >= 0:
        seen[own] = True
    scores, found = np.zeros(0), np.zeros(0, np.int64)
    depth, step, scored = 0, DEPTH, 0
    best = query[up] @ vectors[lists[up, 0], up] + query[down] @ vectors[lists[down, n - 1], down]
    while depth < n and best >= floor:
        to = min(n, depth + step)
        if len(up) + len(down):  # a query of zeros has no lists
            rows = np.concatenate([lists[up, depth:to].ravel(), lists[down, n - to : n - depth].ravel()])
            best = query[up] @ vectors[lists[up, to - 1], up] + query[down] @ vectors[lists[down, n - to], down]
        if not len(up) + len(down) or to * (len(up) + len(down)) >= MOST_READS * n:  # nearly all are seen by now; the rest is scored at once
            rows, to = np.arange(n), n
        fresh = np.zeros(n, bool)
        fresh[rows] = True
        rows = np.flatnonzero(fresh & ~seen)
        seen |= fresh
        scored += len(rows)
        scores, found = np.append(scores, vectors[rows] @ query), np.append(found, rows)
        if len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= least
            scores, found = scores[keep], found[keep]
            order = np.lexsort([ids[found], -scores])[:k]
            scores, found = scores[order], found[order]
        if len(scores) >= k and scores.min() > best:
            break
        depth, step = to, step * 2
    keep = scores >= floor
    scores, found = scores[keep], found[keep]
    order = np.lexsort([ids[found], -scores])[:k]
    return scores[order], found[order], scored


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros, and longer ones are cut, to ``width``."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, out = column.flatten().to_numpy(zero_copy_only=False), np.zeros((len(column), width))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(np.arange(len(column)), lengths)
    inside = place < width
    out[row[inside], place[inside]] = flat[inside]
    return out


def _met(vectors: DataFrame, asked: DataFrame, blocks: int, k: int) -> DataFrame:
    """(query, query_id, vec_id, score, scored): each query's best vectors in the block it is sent to.

    vectors: block, row, id, v; asked: block, row (the query's own), id, v, floor. A task holds one block at a time; queries pass in batches.
    """
    none = F.lit(None).cast("long")
    both = vectors.select("block", none.alias("floor"), "row", "id", "v").unionByName(asked.select("block", "floor", "row", "id", "v"))
    dealt = both.repartition(partition_count(blocks), "block").sortWithinPartitions(F.col("block"), F.col("floor").isNotNull())
    names = ["query", "query_id", "vec_id", "score", "scored"]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, ready = None, [], None
        for batch in batches:
            blocks_, is_query = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for block in np.unique(blocks_).tolist():
                inside = np.flatnonzero(blocks_ == block)
                part, asks = batch.slice(inside[0], len(inside)), is_query[inside]
                if block != now:
                    now, waiting, ready = block, [], None
                own = int(np.searchsorted(asks, True))
                if own:
                    waiting.append(part.slice(0, own))
                if own == part.num_rows or not waiting:
                    continue
                if ready is None:
                    held = pa.Table.from_batches(waiting).combine_chunks()
                    column = held.column("v").combine_chunks()
                    x, ids, rows = _matrix(column, int(column.value_lengths().to_numpy(zero_copy_only=False).max())), held.column("id").to_numpy(), held.column("row").to_numpy()
                    by_row = np.argsort(rows)
                    ready = x, ids, rows, by_row, np.ascontiguousarray(np.argsort(-x, axis=0, kind="stable").T.astype(np.int32))
                    waiting = waiting[:1]
                x, ids, rows, by_row, lists = ready
                part = part.slice(own)
                found = []
                for floor, row, i, q in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), _matrix(part.column(4), x.shape[1]), strict=True):
                    at = min(int(np.searchsorted(rows, row, sorter=by_row)), len(rows) - 1)
                    mine = int(by_row[at]) if rows[by_row[at]] == row else -1
                    scores, best, scored = _search(x, ids, lists, q, mine, k, floor)
                    found.append((np.full(len(best), row), np.full(len(best), i), ids[best], scores, np.where(np.arange(len(best)) == 0, scored, 0)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)], names=names)

    return dealt.mapInArrow(searched, ", ".join(f"{n} long" for n in names))


def top_k(vectors: DataFrame, queries: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` that meets the condition ``queries`` its k rows of highest inner product, ties to smaller ids.

    vectors: (id long, v array<long>), without nulls. A query's own row stays out of its result, other rows of its id do
    not. Rows of equal id are vectors and queries of their own, equal rows too. Vectors of unequal length are compared as if the shorter went on
    with zeros. Products beyond 2**53 are rounded. A single row has no result; an empty table gives none.

    The table is written once, so that a row keeps the number that tells it from others.
    """
    kept = durable(vectors).withColumn("row", F.monotonically_increasing_id())
    count = kept.count()
    blocks = max(1, -(-count // BLOCK), min(parallelism(vectors.sparkSession), -(-count // (BLOCK // 2))))
    number = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    placed, asked = kept.withColumn("block", number), kept.where(queries)
    first = durable(_met(placed, asked.withColumns({"block": number, "floor": F.lit(_NO_FLOOR).cast("long")}), blocks, k))
    best = first
    if blocks > 1:
        floors = first.groupBy(F.col("query").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(_NO_FLOOR).alias("floor"))
        known = asked.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(_NO_FLOOR)).cast("long"))
        others = known.withColumn("home", number).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("block <> home")
        best = first.unionByName(_met(placed, others, blocks, k))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of every component; rows whose id or vector is null, or that hold a null or non-finite component, are left out."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    good = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, finite))
    return good.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def op9_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return top_k(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("id") % EVERY == 0)


#: The same by brute force, for DuckDB.
ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) <= 20
"""
