"""SimHash near-duplicates (operator 7) by a Gray-order hierarchical index.

Fingerprints of 64 bits that differ in at most d bits agree on at least two of d + 2 blocks. For every
two blocks the fingerprints that share that masked bit pattern form an upper node, on which they differ
in no bit. Within it they are sorted by Gray rank, so that neighbours share bits, and gathered into
nodes of a tree; each node keeps the mask of bits that all its members share and their pattern. Two
nodes whose shared bits already differ in more than d places are pruned with all their members; the rest
is compared at the leaves. A node gives away a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.llm.common import durable, find_words, flat_text, joined_words, lower_ascii, parallelism, small_batches, text_pieces, whole_windows
from framesieve.llm.components import component_labels

SHINGLE_WORDS, SEED, MOST_BITS = 4, 42, 4
#: Nodes with more fingerprints than this are split into parts, and every two parts meet in a task of their own.
PART = 20_000
#: Rows that a task compares at a time, at least.
TOGETHER = 50_000
#: Members of a leaf of the tree, and children of an inner node.
LEAF, FAN = 32, 8


def fingerprints(column: pa.Array, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each text as uint64: a bit is set if it is set in over half of the shingles' XXH64.

    Shingles are of ``words`` words in lower case (A-Z only), joined by one blank; a text of fewer
    words is one shingle, a text without words (or null) has fingerprint 0.
    """
    import xxhash

    data, offsets = flat_text(column)
    starts, ends, at = find_words(data, offsets)
    counts = np.diff(at)
    out = np.zeros(len(counts), np.uint64)
    if not len(starts):
        return out
    plain, moved = joined_words(lower_ascii(data), starts, ends)
    first = whole_windows(at, words)
    short = np.flatnonzero((counts > 0) & (counts < words))
    begin = np.concatenate([first, at[short]])
    stop = np.concatenate([first + words, at[short + 1]]) - 1
    order = np.argsort(begin, kind="stable")
    begin, stop = begin[order], stop[order]
    raw, digest = plain.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[s:e], seed) for s, e in zip(moved[begin].tolist(), (moved[stop + 1] - 1).tolist(), strict=True)), np.uint64, len(begin))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.flatnonzero(counts)
    group = np.searchsorted(begin, at[full])
    sums = np.add.reduceat(bits, group, axis=0, dtype=np.int32)
    many = np.diff(np.append(group, len(begin)))
    out[full] = np.packbits(2 * sums > many[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_documents(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document, the fingerprint as a signed long.

    Null texts and texts without words have fingerprint 0; null ids stay; repeated rows each give a row; an empty table gives none; other columns are not read.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), words).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(made, "doc_id long, fp long")


def block_masks(most_bits: int) -> list[int]:
    """The masks of every two of ``most_bits`` + 2 blocks of a 64-bit word."""
    edges = [64 * i // (most_bits + 2) for i in range(most_bits + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class Forest:
    """Sets of 0..n-1 that links join; labels are the least members."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (jumped := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = jumped


def _bits(x: np.ndarray) -> np.ndarray:
    """Set bits of fingerprints; the last axis holds a fingerprint's 64-bit words."""
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


def _link_small(fps: np.ndarray, ends: np.ndarray, forest: Forest, most: int) -> None:
    """Links within groups of a few members: each with the next, the next but one, and so on."""
    left, step = np.flatnonzero(ends - np.arange(len(fps)) > 1), 1
    while len(left):
        near = left[_bits(fps[left] ^ fps[left + step]) <= most]
        forest.join(near, near + step)
        step += 1
        left = left[left + step < ends[left]]


def _link_tree(low: int, fps: np.ndarray, forest: Forest, most: int) -> None:
    """Links among fps (in Gray order; numbered from ``low``) by descending pairs of tree nodes."""
    words = fps.shape[1]
    index = np.minimum(np.arange(-(-len(fps) // LEAF) * LEAF), len(fps) - 1).reshape(-1, LEAF)
    leaves = fps[index]
    every, some = [np.bitwise_and.reduce(leaves, axis=1)], [np.bitwise_or.reduce(leaves, axis=1)]
    while len(every[-1]) > FAN:
        starts = np.arange(0, len(every[-1]), FAN)
        every.append(np.bitwise_and.reduceat(every[-1], starts))
        some.append(np.bitwise_or.reduceat(some[-1], starts))
    a, b = np.triu_indices(len(every[-1]))
    for level in range(len(every) - 1, -1, -1):
        shared = ~(every[level] ^ some[level])
        keep = _bits((every[level][a] ^ every[level][b]) & shared[a] & shared[b]) <= most
        a, b = a[keep], b[keep]
        if level:
            below = len(every[level - 1])
            x = np.repeat(a[:, None] * FAN + np.arange(FAN), FAN, axis=1).ravel()
            y = np.tile(b[:, None] * FAN + np.arange(FAN), (1, FAN)).ravel()
            inside = (x <= y) & (x < below) & (y < below)
            a, b = x[inside], y[inside]
    members = index + low
    for at in range(0, len(a), 256):
        i, j = a[at : at + 256], b[at : at + 256]
        own = forest.label[members]
        whole = (own[i] == own[i, :1]).all(axis=1) & (own[j] == own[i, :1]).all(axis=1)
        i, j = i[~whole], j[~whole]
        apart = np.zeros((len(i), LEAF, LEAF), np.int32)
        for w in range(words):
            apart += np.bitwise_count(leaves[i, :, None, w] ^ leaves[j, None, :, w])
        pair, x, y = np.nonzero(apart <= most)
        forest.join(members[i[pair], x], members[j[pair], y])


def link_sorted(groups: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, rows): each row of a set that links join within a group beside the set's least fingerprint.

    Sets that meet in many nodes mostly share their least member, so their links are mostly the same ones.
    groups: sorted; fps: one row of 64-bit words each, in Gray order of the first word within a group.
    """
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    stops = np.append(starts[1:], len(groups))
    forest = Forest(len(fps))
    small = np.repeat(stops - starts <= 2 * LEAF, stops - starts)
    _link_small(fps, np.where(small, np.repeat(stops, stops - starts), 0), forest, most)
    for s, e in zip(starts, stops, strict=True):
        if e - s > 2 * LEAF:
            _link_tree(s, fps[s:e], forest, most)
    order = np.lexsort(fps.T)
    rank, least = np.empty(len(fps), np.int64), np.full(len(fps), len(fps))
    rank[order] = np.arange(len(fps))
    np.minimum.at(least, forest.label, rank)
    root = order[least[forest.label]]
    child = np.flatnonzero(root != np.arange(len(fps)))
    return root[child], child


def link_nodes(spread: DataFrame, names: list[str], most_bits: int) -> DataFrame:
    """(a_<name>..., b_<name>...): links that connect, perhaps through others, all close fingerprints that share an upper node.

    spread: node, pattern (longs that name an upper node) and the fingerprint's words ``names``; read more
    than once. A node comes to one task. A node of more than PART members is dealt into parts by
    hash, and every two parts into a task; so a task holds two parts at most, whatever a node holds.
    """
    large = durable(spread.groupBy("node", "pattern").count().where(F.col("count") > PART).select(F.col("node").alias("n"), F.col("pattern").alias("p"), F.ceil(F.col("count") / PART).alias("parts")))
    if large.head(1):
        joined = spread.join(large, (spread["node"] == large["n"]) & (spread["pattern"] == large["p"]), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = joined.withColumn("own", F.pmod(F.xxhash64(*names), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        keyed = dealt.select(F.xxhash64("node", "pattern", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *names)
    else:
        keyed = spread.select(F.xxhash64("node", "pattern").alias("key"), *names)
    dealt = keyed.repartition(parallelism(spread.sparkSession), "key").sortWithinPartitions("key")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros((0, len(names)), np.uint64)

        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a = b = fps
            if len(keys):
                order = np.lexsort((gray_rank(fps[:, 0]), keys))
                fps = fps[order]
                x, y = link_sorted(keys[order], fps, most_bits)
                a, b = fps[x], fps[y]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(side[:, w]).view(np.int64)) for side in (a, b) for w in range(len(names))], names=[f"{side}_{n}" for side in "ab" for n in names])

        waiting, rows = [(keys, fps)], 0
        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[1:]], axis=1)))
            rows += batch.num_rows
            if rows >= TOGETHER:
                keys, fps = (np.concatenate(x) for x in zip(*waiting, strict=True))
                done = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                if done:
                    yield links(keys[:done], fps[:done])
                waiting, rows = [(keys[done:], fps[done:])], 0
        keys, fps = (np.concatenate(x) for x in zip(*waiting, strict=True))
        yield links(keys, fps)

    return dealt.mapInArrow(linked, ", ".join(f"{side}_{n} long" for side in "ab" for n in names))


def _signed(word: int) -> int:
    return word - (1 << 64) if word >= 1 << 63 else word


def close_links(nodes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b): links that connect every two of the distinct fingerprints ``nodes`` (column fp) that differ in at most
    ``most_bits`` bits, perhaps through others; the ends of a link are connected by such steps."""
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in block_masks(most_bits)])
    spread = nodes.select("fp", F.posexplode(masks).alias("node", "mask")).select("node", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp")
    return link_nodes(spread, ["fp"], most_bits).toDF("a", "b")


def near_duplicate_groups(fingerprinted: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least id reachable by links of at most ``most_bits`` bits.

    fingerprinted: doc_id, fp; read more than once, so give a durable table. Null ids are kept and
    count for a component only if it has no other; repeated rows each give a row; an empty table gives none.
    Equal fingerprints are one node, so any number of copies costs one row for each task.
    """
    nodes = durable(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = component_labels(close_links(nodes, most_bits))
    rooted = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    rooted = durable(rooted)
    parts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = rooted.join(parts, "root").select(F.col("fp").alias("f"), "component_id")
    return fingerprinted.join(component, fingerprinted["fp"] == component["f"]).select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    fingerprinted = durable(fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return near_duplicate_groups(fingerprinted).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
