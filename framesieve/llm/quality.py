"""Quality classifier (operator 1) by co-training two views of a document.

The text view is a logistic regression on the presence of hashed words and sign runs. The metadata view is one on
language, source, length and layout counts (signs, digits, capitals, word lengths, repeats, lines). Both are
fitted on a bounded sample of labelled documents. Then, for some rounds, each view scores all other documents, and of those it is
surest of, of either kind, it labels a share of the corpus for the other view to learn from. The views are calibrated on labelled
documents kept out of all that, and their combination fitted on other ones kept out. Every document is scored.

A document is good if its label says quality and not toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesieve.llm.common import durable, flat_text, lower_ascii, map_whole, mix64, small_batches, text_pieces, unused, word_hashes

#: Most labelled documents fitted on (a sample by hash of the id), rounds, and which share of all documents a view labels in a round, as good and as bad.
LABELLED, ROUNDS, GIVEN = 12_000, 3, 0.02
#: Most pseudo-labels that one fit takes, of all rounds, views and kinds: the fit is on the driver, as that on LABELLED documents is.
MOST_GIVEN = 6_000
#: How sure a view must be to give a label, what such a label weighs, and the shares of labelled documents kept out for calibration and for combination.
SURE, PSEUDO_WEIGHT, CALIBRATE, COMBINE = 0.9, 0.3, 0.15, 0.15
#: Steps of a logit by which documents are told surer than others.
STEPS = 64
#: Text features: hash buckets, in how many sampled documents a bucket must occur, and by how many standard errors its share among good and bad ones must differ.
TEXT_BITS, LEAST_DOCS, LEAST_Z = 18, 4, 5.0
#: Metadata features: hash buckets of languages and of sources.
NAME_BUCKETS = 64

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_SPACE_BYTE = np.zeros(256, bool)
_SPACE_BYTE[[0x20, *range(0x09, 0x0E)]] = True


def _runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of runs of equal ``kind`` above 0 within texts."""
    edge = np.ones(len(kind), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(kind)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(kind))
    keep = kind[starts] > 0
    return starts[keep], ends[keep]


def features(text: pa.Array, lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text buckets, offsets of the documents' buckets, metadata matrix); nulls count as empty."""
    data, offsets = flat_text(text)
    n = len(offsets) - 1
    low = lower_ascii(data)
    kind = np.where(_WORD_BYTE[low], 1, np.where(_SPACE_BYTE[low], 0, 2)).astype(np.int8)
    starts, ends = _runs(kind, offsets)
    hashes = word_hashes(low, starts, ends)
    owner = np.searchsorted(offsets, starts, "right") - 1
    keyed = np.unique((owner.astype(np.uint64) << np.uint64(TEXT_BITS)) | (hashes >> np.uint64(64 - TEXT_BITS)))
    at = np.searchsorted(keyed >> np.uint64(TEXT_BITS), np.arange(n + 1, dtype=np.uint64))
    buckets = (keyed & np.uint64((1 << TEXT_BITS) - 1)).astype(np.int32)

    def summed(values: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.bincount(where, weights=values, minlength=n)[:n]

    size = np.diff(offsets).astype(np.float64)
    byte_owner = np.repeat(np.arange(n), np.diff(offsets))
    signs, gaps = summed(kind == 2, byte_owner), summed(kind == 0, byte_owner)
    digits, capitals = summed((data >= 0x30) & (data <= 0x39), byte_owner), summed((data >= 0x41) & (data <= 0x5A), byte_owner)
    lines, wide = summed(data == 0x0A, byte_owner), summed(data >= 0x80, byte_owner)
    words = summed(kind[starts] == 1, owner)
    long_signs = summed((kind[starts] == 2) & (ends - starts > 1), owner)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    repeats = summed(same, owner)
    many, some = np.maximum(size, 1), np.maximum(words, 1)
    dense = np.stack([np.log1p(size), signs / many, digits / many, capitals / many, gaps / many, wide / many, lines / some, words / many, long_signs / some, repeats / some, np.diff(at) / np.maximum(summed(np.ones(len(starts)), owner), 1), (size == 0) * 1.0], axis=1)
    names = np.zeros((n, 2 * NAME_BUCKETS))
    for k, column in enumerate((lang, source)):
        own, edges = flat_text(column.cast(pa.string()))
        bucket = np.zeros(n, np.int64)
        full = np.flatnonzero(np.diff(edges))
        if len(full):
            bucket[full] = (word_hashes(own, edges[:-1][full], edges[1:][full]) % np.uint64(NAME_BUCKETS - 1)).astype(np.int64) + 1
        names[np.arange(n), k * NAME_BUCKETS + bucket] = 1
    return buckets, at, np.concatenate([dense, names], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Sparse:
    """Rows of feature indices (all of value 1)."""

    def __init__(self, index: np.ndarray, offsets: np.ndarray, width: int) -> None:
        self.index, self.offsets, self.width = index, offsets, width
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.index], minlength=len(self.offsets) - 1)

    def turned(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=r[self.row], minlength=self.width)


class _Dense:
    def __init__(self, x: np.ndarray) -> None:
        self.x, self.width = x, x.shape[1]

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def turned(self, r: np.ndarray) -> np.ndarray:
        return self.x.T @ r


def _fit(x: _Sparse | _Dense, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 300, rate: float = 0.1) -> np.ndarray:
    """Coefficients (the intercept last) of a ridge logistic regression, by Adam."""
    weight = weight / max(weight.sum(), 1e-9)
    w, m, v = (np.zeros(x.width + 1) for _ in range(3))
    for t in range(1, steps + 1):
        r = weight * (_sigmoid(x.times(w[:-1]) + w[-1]) - y)
        g = np.append(x.turned(r) + ridge * w[:-1], r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class QualityModel:
    """Both views' coefficients and how to calibrate and combine them."""

    slot: np.ndarray  # of each text bucket among the text coefficients, the last one if unused
    text: np.ndarray
    meta: np.ndarray
    center: np.ndarray
    spread: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    blend: np.ndarray

    def scores(self, buckets: np.ndarray, at: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of being good by the text view, the metadata view, and both."""
        n = len(at) - 1
        row = np.repeat(np.arange(n), np.diff(at))
        weights = np.append(self.text[:-1], 0.0)
        a = np.bincount(row, weights=weights[self.slot[buckets]], minlength=n)[:n] + self.text[-1]
        b = ((meta - self.center) / self.spread) @ self.meta[:-1] + self.meta[-1]
        a, b = a * self.text_scale[0] + self.text_scale[1], b * self.meta_scale[0] + self.meta_scale[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.blend[0] * a + self.blend[1] * b + self.blend[2])


_PLAIN = np.array([1.0, 0.0])


def fit_views(sample: list[tuple[np.ndarray, np.ndarray]], labels: dict[str, np.ndarray], weight: np.ndarray) -> QualityModel:
    """Both views, not calibrated yet. sample: (text buckets, metadata) of each document; labels: of the view, 1, 0 or NaN (not for this view)."""
    meta = np.array([m for _, m in sample])
    lengths = np.array([len(b) for b, _ in sample])
    buckets = np.concatenate([b for b, _ in sample])
    used = np.flatnonzero(np.bincount(buckets, minlength=1 << TEXT_BITS) >= LEAST_DOCS)
    slot = np.full(1 << TEXT_BITS, len(used), np.int32)
    slot[used] = np.arange(len(used))
    row, index = np.repeat(np.arange(len(sample), dtype=np.int32), lengths), slot[buckets]
    del buckets
    own = ~np.isnan(labels["meta"])
    center, spread = meta[own].mean(axis=0), meta[own].std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    meta_view = _fit(_Dense((meta[own] - center) / spread), labels["meta"][own], weight[own], 1e-4)
    own = ~np.isnan(labels["text"])
    y, w = labels["text"][own], weight[own]
    keep = own[row] & (index < len(used))
    number = np.cumsum(own) - 1

    def rows(keep: np.ndarray, column: np.ndarray, width: int) -> _Sparse:
        return _Sparse(column[index[keep]], np.append(0, np.cumsum(np.bincount(number[row[keep]], minlength=len(y)))).astype(np.int64), width)

    good_docs, bad_docs = max((w * y).sum(), 1e-9), max((w * (1 - y)).sum(), 1e-9)
    in_good, in_bad = (np.bincount(index[keep], (w * v)[number[row[keep]]], len(used)) for v in (y, 1 - y))
    both = (in_good + in_bad) / (good_docs + bad_docs)
    z = (in_good / good_docs - in_bad / bad_docs) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / good_docs + 1 / bad_docs))
    telling = np.append(np.abs(z) >= LEAST_Z, False)
    fitted = _fit(rows(keep & telling[index], np.cumsum(telling) - 1, int(telling.sum())), y, w, 2e-5, 600)
    text_view = np.zeros(len(used) + 1)
    text_view[:-1][telling[:-1]], text_view[-1] = fitted[:-1], fitted[-1]
    return QualityModel(slot, text_view, meta_view, center, spread, _PLAIN, _PLAIN, np.array([0.5, 0.5, 0.0]))


def _scaled(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """A logistic scale for columns of logits; as they are where both kinds of documents are not there."""
    return _fit(_Dense(x), good, np.ones(len(good)), 1e-4, 600) if len(good) and 0 < good.sum() < len(good) else np.append(np.ones(x.shape[1]), 0.0)


def _logits(model: QualityModel, sample: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Columns of both views' logits."""
    if not sample:
        return np.zeros((0, 2))
    at = np.append(0, np.cumsum([len(b) for b, _ in sample]))
    p = np.clip(np.stack(model.scores(np.concatenate([b for b, _ in sample]), at, np.array([m for _, m in sample]))[:2], axis=1), 1e-12, 1 - 1e-12)
    return np.log(p / (1 - p))


def calibrate(model: QualityModel, kept_out: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, combine: np.ndarray) -> QualityModel:
    """The model with each view scaled on kept-out documents, and both blended on those of them that ``combine`` marks."""
    x = _logits(model, kept_out)
    text_scale, meta_scale = (_scaled(x[~combine, v : v + 1], good[~combine]) for v in (0, 1))
    y = x[combine] * [text_scale[0], meta_scale[0]] + [text_scale[1], meta_scale[1]]
    blend = _scaled(y, good[combine])
    if not combine.any():
        blend = np.array([0.5, 0.5, 0.0])
    return replace(model, text_scale=text_scale, meta_scale=meta_scale, blend=blend)


def _place(*columns: str):
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns, F.lit("quality")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _sample_features(given: DataFrame, chosen: DataFrame) -> pa.Table:
    """(doc_id, buckets, meta) of the chosen ids (a bounded number), by id; of rows of one id the one whose text has the least hash."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches):
            buckets, at, meta = features(*batch.columns[2:])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(buckets)), pa.array(list(meta), pa.list_(pa.float64()))], names=["doc_id", "content", "buckets", "meta"])

    found = given.join(F.broadcast(chosen.select("doc_id")), "doc_id").select("doc_id", "content", "text", "lang", "source")
    made_rows = found.mapInArrow(made, "doc_id long, content long, buckets array<int>, meta array<double>")
    one = made_rows.groupBy("doc_id").agg(F.min_by(F.struct("buckets", "meta"), "content").alias("x"))
    return one.select("doc_id", "x.buckets", "x.meta").toArrow().sort_by("doc_id")


def _rows(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.asarray(b.values.to_numpy(), np.int32), m.values.to_numpy()) for b, m in zip(table.column("buckets"), table.column("meta"), strict=True)]


def _surest(given: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, view, good): labels that each view gives the other: of each kind the documents that it is surest of, GIVEN of all, as long as it is SURE; of equal texts one.

    How sure is told by counts of steps of the logit; of the step in which the number is reached a hash of the text picks. At most MOST_GIVEN / (4 * ROUNDS) of a view and kind. The model is as in ``fit_views``.
    """
    shared = given.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches):
            p = np.clip(np.stack(shared.value.scores(*features(*batch.columns[2:]))[:2]), 1e-12, 1 - 1e-12)
            text, meta = np.log(p / (1 - p))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text), pa.array(meta)], names=["doc_id", "content", "text", "meta"])

    views = given.select("doc_id", "content", "text", "lang", "source").mapInArrow(scored, "doc_id long, content long, text double, meta double")
    by_view = views.select("doc_id", "content", F.explode(F.array(*(F.struct(F.lit(of).alias("view"), F.col(by).alias("x")) for by, of in (("text", "meta"), ("meta", "text"))))).alias("v"))
    told = by_view.groupBy("content", "v.view").agg(F.min("doc_id").alias("doc_id"), F.min_by("v.x", F.struct("doc_id", "v.x")).alias("x"))  # equal texts of other metadata may differ in x; one of them teaches
    told = durable(told.select("doc_id", "content", "view", (F.col("x") > 0).alias("good"), F.floor(F.abs("x") * STEPS).cast("int").alias("step")))
    most = min(int(np.ceil(GIVEN * told.where("view = 'text'").count())), MOST_GIVEN // (4 * ROUNDS))
    least = int(np.ceil(np.log(SURE / (1 - SURE)) * STEPS))
    counts: dict[tuple[str, bool], dict[int, int]] = {}
    for r in told.where(F.col("step") >= least).groupBy("view", "good", "step").count().collect():  # steps of a logit up to 28
        counts.setdefault((r["view"], r["good"]), {})[r["step"]] = r["count"]
    share = F.lit(0.0)
    for (view, good), steps in counts.items():
        left, last = most, least
        for last in sorted(steps, reverse=True):
            if steps[last] >= left:
                break
            left -= steps[last]
        part = F.when(F.col("step") > last, 1.0).when(F.col("step") == last, min(left / steps[last], 1.0)).otherwise(0.0)
        share = F.when((F.col("view") == view) & (F.col("good") == good), part).otherwise(share)
    return told.where((F.col("step") >= least) & (_place("content") < share)).select("doc_id", "view", "good")


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """The model from documents (doc_id, text, lang, source) and labels (doc_id, quality, toxic).

    Labels of null quality are left out, a null toxic is 0, of repeated labels of an id, or of equal texts, the worst counts. LABELLED labelled
    documents, picked by a hash of the id, come to the driver as features, and in each round four times GIVEN of all, MOST_GIVEN in all rounds; these are chosen among all
    documents, labelled ones beyond LABELLED too. Null ids teach nothing. Without labels every document scores 0.5.
    """
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") > 0) & (F.coalesce("toxic", F.lit(0)) <= 0)).cast("double").alias("good"))
    sample = durable(marked.groupBy("doc_id").agg(F.min("good").alias("good")).orderBy(_place("doc_id"), "doc_id").limit(LABELLED))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text", "lang", "source").where("doc_id IS NOT NULL")
    table = _sample_features(given, sample)
    if not table.num_rows:
        width = features(pa.array([""]), pa.array([""]), pa.array([""]))[2].shape[1]
        return QualityModel(np.zeros(1 << TEXT_BITS, np.int32), np.zeros(1), np.zeros(width + 1), np.zeros(width), np.ones(width), _PLAIN, _PLAIN, np.zeros(3))
    label_of = dict(sample.toArrow().to_pandas().itertuples(index=False))
    taught: dict[bytes, tuple[tuple, float, int]] = {}  # by text: copies of a labelled document teach once, by their worst label
    for i, row in zip(table.column("doc_id").to_pylist(), _rows(table), strict=True):
        own = row[0].tobytes()
        taught[own] = (row, min(label_of[i], taught[own][1]), taught[own][2]) if own in taught else (row, label_of[i], i)
    known = [row for row, _, _ in taught.values()]
    good = np.array([g for _, g, _ in taught.values()])
    part = (mix64(np.array([i for _, _, i in taught.values()], np.int64).view(np.uint64)) >> np.uint64(40)) / float(1 << 24)
    out = np.flatnonzero(part < CALIBRATE + COMBINE) if len(good) > 10 else np.zeros(0, np.int64)
    inside = np.setdiff1d(np.arange(len(good)), out)
    rows = [known[i] for i in inside.tolist()]
    answers = {view: good[inside] for view in ("text", "meta")}
    model = fit_views(rows, answers, np.ones(len(rows)))
    others = given.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")
    pseudo: dict[int, dict[str, float]] = {}
    held: dict[int, tuple] = {}
    for _ in range(ROUNDS):
        chosen = durable(_surest(others, model))  # a bounded number
        found = _sample_features(others, chosen.select("doc_id").distinct())
        held |= dict(zip(found.column("doc_id").to_pylist(), _rows(found), strict=True))
        for r in chosen.collect():
            pseudo.setdefault(r["doc_id"], {}).setdefault(r["view"], float(r["good"]))
        more = [i for i in sorted(pseudo) if i in held]
        if not more:
            break
        labels_of = {view: np.append(answers[view], [pseudo[i].get(view, np.nan) for i in more]) for view in answers}
        model = fit_views([*rows, *(held[i] for i in more)], labels_of, np.append(np.ones(len(rows)), np.full(len(more), PSEUDO_WEIGHT)))
    return calibrate(model, [known[i] for i in out.tolist()], good[out], part[out] < COMBINE)


#: The columns that ``score_quality`` adds.
SCORES = ("text_score", "meta_score", "score", "keep")


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with text_score, meta_score, score (probabilities of being good) and keep (score of 0.5 or more) added; nothing is shuffled.

    Null text, language and source count as empty; repeated rows each give a row; an empty table gives none. All columns of
    ``docs`` stay; where one has such a name already, the new column gets underscores behind it.
    """
    names = unused(list(SCORES), docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [docs.columns.index(c) for c in ("text", "lang", "source")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in text_pieces(batches, f"c{columns[0]}"):
            yield [*batch.columns, *map(pa.array, shared.value.scores(*features(*(batch.column(c) for c in columns))))]

    return map_whole(docs, scored, [T.StructField(n, T.DoubleType()) for n in names[:3]]).withColumn(names[3], F.col(names[2]) >= 0.5)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", "text_score", "meta_score", "score", "keep")
