"""Near-duplicate documents by word shingles: SimHash candidates, exact Jaccard similarity, one document kept of each group.

Two sets of similarity t share one of their first n - ceil(t n) + 1 shingles in any common order, n being
a set's size. These shingles are the upper nodes here, rare ones first in the order (by how many shingles of all texts
their bucket of hashes holds), so no pair is missed for its size or the table's. Fingerprints that
share an upper node and are close by all 128 bits of their SimHashes are candidates, by operator 7's tree; the
limit of bits is one that a pair of similarity t exceeds with probability LOST. Connected candidates
form a cluster, and within a cluster the shingle sets themselves decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesieve.llm.common import durable, find_words, flat_text, lower_ascii, mix64, parallelism, quoted, text_pieces, unused, whole_windows, window_hashes, word_hashes
from framesieve.llm.components import component_labels
from framesieve.llm.simhash import Forest, link_nodes

WORDS, SIMILARITY, LOST = 5, 0.8, 1e-9
BITS = 128
#: Leading bits of a shingle's hash that name its bucket: 2 MB of counts, whatever the table.
BUCKET_BITS = 18
#: Members of a cluster that one task compares with as many others; shingles compared at a time.
MEMBERS, COLUMNS = 400, 4096
#: Tables of ids up to so many rows are broadcast; beyond, Spark joins them by a shuffle.
BROADCAST_ROWS = 1_000_000


def shingle_hashes(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle of lower-case words, offsets of the texts' shingles); a shorter text is one shingle, one without words has none."""
    data, offsets = flat_text(column)
    data = lower_ascii(data)
    starts, ends, at = find_words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    counts = np.diff(at)
    first = whole_windows(at, words)
    found = window_hashes(hashes, words)[first]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        extra = np.array([window_hashes(hashes[at[i] : at[i + 1]], int(counts[i]))[0] for i in short.tolist()], np.uint64)
        first, found = np.append(first, at[short]), np.append(found, extra)
        order = np.argsort(first, kind="stable")
        first, found = first[order], found[order]
    return found, np.searchsorted(first, at)


def distinct_shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct shingles in order, offsets of the texts' shingles)."""
    hashes, at = shingle_hashes(column, words)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.searchsorted(owner[fresh], np.arange(len(at)))


def wide_fingerprints(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 128-bit SimHash of each text's distinct shingles as two 64-bit words."""
    out = np.zeros((len(at) - 1, BITS // 64), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for w in range(BITS // 64):
            bits = np.unpackbits(mix64(hashes + np.uint64(w)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, at[full], axis=0, dtype=np.int32)
            out[full, w] = np.packbits(2 * sums > np.diff(at)[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def set_hashes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's distinct shingles, 0 for a text without words."""
    out = np.zeros(len(at) - 1, np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(mix64(hashes + np.uint64(BITS)), at[full])
    return out


def most_bits(similarity: float) -> int:
    """Fingerprints of sets of that similarity differ in more bits with probability LOST at most (sets of a few shingles: 5e-7 at 0.8)."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi  # by the cosine of two sets of equal size
    left, most = 1.0, -1
    while left > LOST and most < BITS:
        most += 1
        left -= math.comb(BITS, most) * differ**most * (1 - differ) ** (BITS - most)
    return most


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucket_counts(given: DataFrame, words: int) -> np.ndarray:
    """How many distinct shingles of all texts of given (doc_id, content, text) fall into each bucket of hashes."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in text_pieces(batches):
            counts += np.bincount(_bucket(distinct_shingles(batch.column(0), words)[0]), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    found = given.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def prefix_shingles(hashes: np.ndarray, at: np.ndarray, counts: np.ndarray, similarity: float) -> pa.Array:
    """Of each text's distinct shingles the first n - ceil(similarity n) + 1, those of buckets of few shingles being first in order."""
    sizes = np.diff(at)
    order = np.lexsort((hashes, counts[_bucket(hashes)], np.repeat(np.arange(len(sizes)), sizes)))
    some = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-6).astype(np.int64) + 1, 0)
    kept = hashes[order][np.arange(len(hashes)) - np.repeat(at[:-1], sizes) < np.repeat(some, sizes)]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some)).astype(np.int32)), pa.array(kept.view(np.int64)))


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


def _similar_pairs(sets: list[np.ndarray], split: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < split <= j (or i < j if split is 0), whose sets have at least that Jaccard similarity."""
    distinct, which = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    low, high = (split, split) if split else (len(sets), 0)
    common = np.zeros((low, len(sets) - high), np.float32)
    for at in range(0, len(distinct), COLUMNS):
        s, e = np.searchsorted(which, (at, at + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[s:e], which[s:e] - at] = 1
        common += part[:low] @ part[high:].T
    sizes = np.array([len(x) for x in sets], np.float64)
    union = sizes[:low, None] + sizes[None, high:] - common
    i, j = np.nonzero(common >= similarity * union - 1e-9)
    j = j + high
    keep = i < j
    return i[keep], j[keep]


def _verified_links(members: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links between members (cluster, member, text) of one cluster whose shingle sets are similar enough: a spanning forest of them in each task.

    Clusters of more than MEMBERS are dealt into parts, and every two parts into a task.
    """
    sizes = members.groupBy("cluster").count().select("cluster", F.ceil(F.col("count") / MEMBERS).cast("int").alias("parts"))
    hashed = members.mapInArrow(lambda batches: _with_shingles(batches, words), "cluster long, member long, shingles array<long>")
    parted = _joined(durable(hashed), durable(sizes), ["cluster"]).withColumn("own", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
    spread = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = spread.select(F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("task"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cluster", "own", "member", "shingles")
    dealt = keyed.repartition(parallelism(members.sparkSession), "task").sortWithinPartitions("task", "cluster", "i", "j", "own")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> pa.RecordBatch:
            split = sum(own == now[1] for own, _, _ in held) if now[1] != now[2] else 0
            if now[1] != now[2] and split in (0, len(held)):
                i = j = np.zeros(0, np.int64)
            else:
                i, j = _similar_pairs([x for _, _, x in held], split, similarity)
            forest = Forest(len(held))
            forest.join(i, j)
            ids = np.array([m for _, m, _ in held], np.int64)
            child = np.flatnonzero(forest.label != np.arange(len(held)))
            return pa.RecordBatch.from_arrays([pa.array(ids[forest.label[child]]), pa.array(ids[child])], names=["a", "b"])

        for batch in batches:
            flat = batch.column(6)
            values, offsets = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
            for r, (task, i, j, cluster, own, member) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True)):
                if (cluster, i, j) != now:
                    if len(held) > 1:
                        yield links()
                    now, held = (cluster, i, j), []
                held.append((own, member, values[offsets[r] : offsets[r + 1]]))
        if len(held) > 1:
            yield links()

    return dealt.mapInArrow(linked, "a long, b long")


def _with_shingles(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in text_pieces(batches):
        hashes, at = distinct_shingles(batch.column(2), words)
        sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], names=["cluster", "member", "shingles"])


def near_copy_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content, root, component_id): component_id is the least id among documents linked by shingle sets of at
    least that Jaccard similarity, perhaps through others; root names the group; content is Spark's xxhash64 of the text.

    Documents of equal shingle sets (copies; also all texts without words, null ones among them) are one
    node; nodes of equal fingerprints are candidates like others. Null ids count for a component only if it has no other; repeated rows each give a row; an empty table gives none.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches):
            hashes, at = distinct_shingles(batch.column(2), words)
            fps, node = wide_fingerprints(hashes, at).view(np.int64), set_hashes(hashes, at).view(np.int64)
            keys = prefix_shingles(hashes, at, shared.value, similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array(np.ascontiguousarray(fps[:, 0])), pa.array(np.ascontiguousarray(fps[:, 1])), keys], names=["doc_id", "content", "node", "f0", "f1", "keys"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(bucket_counts(given, words))
    printed = durable(given.mapInArrow(made, "doc_id long, content long, node long, f0 long, f1 long, keys array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "f0", "f1", "keys"))
    nodes = durable(printed.groupBy("node").agg(first.alias("x")).select("node", "x.doc_id", "x.content", "x.f0", "x.f1", F.xxhash64("x.f0", "x.f1").alias("print"), "x.keys"))
    prints = durable(nodes.groupBy("print", "f0", "f1").agg(F.count("*").alias("sets")))
    spread = nodes.select(F.lit(0).alias("node"), F.explode("keys").alias("pattern"), "f0", "f1")
    candidates = link_nodes(spread, ["f0", "f1"], most_bits(similarity)).select(F.xxhash64("a_f0", "a_f1").alias("a"), F.xxhash64("b_f0", "b_f1").alias("b"))
    linked = component_labels(candidates).select(F.col("node").alias("print"), F.col("label").alias("cluster"))
    clusters = prints.join(linked, "print", "left").where("cluster is not null or sets > 1").select("print", F.coalesce("cluster", "print").alias("cluster"))
    members = durable(nodes.join(durable(clusters), "print").select("cluster", F.col("node").alias("member"), "doc_id", "content"))
    texts = given.withColumn("id", F.coalesce("doc_id", F.lit(0))).drop("doc_id")
    wanted = members.select("cluster", "member", F.coalesce("doc_id", F.lit(0)).alias("id"), "content")
    found = _joined(texts, wanted, ["id", "content"]).select("cluster", "member", "text")
    labels = component_labels(_verified_links(found, words, similarity))
    rooted = durable(nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = rooted.join(least, "root").select("node", "root", "component_id")
    return printed.join(component, "node").select("doc_id", "content", "root", "component_id")


def keep_one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have a near copy of smaller id (null ids are larger than all others); groups as in ``near_copy_groups``.

    Rows equal in id and text are one document, of which one row stays. Texts without words, null ones among them, are one
    group. An empty table gives none. All columns stay as they are, whatever their names.
    """
    groups = durable(near_copy_groups(docs, words, similarity, id_col, text_col))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "content")
    first = groups.groupBy("root").agg(F.min(place).alias("first"))
    gone = durable(groups.join(first, "root").where(place != F.col("first")).select(place.alias("key")).distinct())
    again = durable(groups.groupBy(place.alias("key")).count().where("count > 1").select("key"))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text_col).alias("content"))
    (name,) = unused(["key"], docs.columns)
    left = _joined(docs.withColumn(name, key), gone.withColumnRenamed("key", name), [name], "left_anti")
    if again.head(1):
        again = again.withColumnRenamed("key", name)
        left = _joined(left, again, [name], "left_anti").unionByName(_joined(left, again, [name], "left_semi").dropDuplicates([name]))
    return left.select(*map(quoted, docs.columns))
