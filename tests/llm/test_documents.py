"""Operators over whole tables of documents against brute force."""

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from framesieve.llm import bloom_lm as L
from framesieve.llm import mixing as M
from framesieve.llm import near_copies as N
from framesieve.llm import order_minhash as O
from framesieve.llm import quality as Q
from framesieve.llm import simhash as S
from framesieve.llm import substring_dedup as D
from framesieve.llm import threshold_topk as K
from framesieve.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import plain
from tests.llm.conftest import EDGES, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(name, spark, sf, duck):
    assert plain(QUERIES[name](spark, sf).toPandas()) == plain(duck.execute(ORACLE_SQL[name]).df())


def without_repeats(rows):
    """(id, text) rows to (id, words, removed, kept text): equal ids are one document."""
    inf = float("inf")
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 19):
            k, at = tuple(w[p : p + 20]), (inf if i is None else i, p)
            first[k] = min(first.get(k, at), at)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] != (inf if i is None else i, p):
                gone[p : p + 20] = [True] * 20
        out.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("filter_bytes", [D.FILTER_BYTES, 40])
def test_substring_dedup(spark, edges, empty, monkeypatch, filter_bytes):
    monkeypatch.setattr(D, "FILTER_BYTES", filter_bytes)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, t) for i, t, *_ in EDGES] + [(None, f"n{k} {passage} z{k}") for k in range(5)] + [(20, f"a b {passage} c"), (21, f"x {passage} y {passage}"), (22, passage[: len(passage) // 2]), (23, "q " * 19), (24, " ".join(f"p{i}" for i in range(5, 25)))]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in D.drop_repeats(frame(spark, rows)).collect())
    assert got == without_repeats(rows)
    assert D.drop_repeats(empty).count() == 0


def test_cover_differences():
    assert {(a - b) % D.PERIOD for a in D.COVER for b in D.COVER} == set(range(D.PERIOD))


def brute_fingerprint(text, n=4):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            least = min(label[a], label[b])
            changed |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return label


def test_simhash(spark, edges, empty):
    small = frame(spark, [(i, t if t is None else t[:3000]) for i, t, *_ in EDGES])
    got = S.near_duplicate_groups(S.fingerprint_documents(small)).toPandas()
    assert sorted((str(i), f) for i, f in zip([None if pd.isna(x) else int(x) for x in got.doc_id], got.fp.astype("int64").to_numpy().view("uint64").tolist(), strict=True)) == sorted((str(i), brute_fingerprint(t if t is None else t[:3000])) for i, t, *_ in EDGES)
    by_id = {int(i): int(c) for i, c in zip(got.doc_id, got.component_id, strict=True) if i == i and c == c}
    assert by_id[6] == 1 and by_id[2] == by_id[3] == by_id[4] == by_id[12] == 2
    assert S.near_duplicate_groups(S.fingerprint_documents(empty)).count() == 0


@pytest.mark.parametrize("part", [S.PART, 50])
def test_close_fingerprints(spark, monkeypatch, part):
    monkeypatch.setattr(S, "PART", part)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.left_shift(np.uint64(1), rng.integers(0, 64, (900, 3)).astype(np.uint64)), axis=1)
    f = np.unique(np.append(base[rng.integers(0, 12, 900)] ^ flips, rng.integers(0, 2**63, 100, dtype=np.uint64)))
    got = S.near_duplicate_groups(spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(len(f)), "fp": f.view(np.int64)}))).toPandas().sort_values("doc_id").component_id.tolist()
    near = np.argwhere(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4)
    assert got == closure(len(f), near.tolist())


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_copies(spark, sf, edges, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = docs.where("n_chars > 800").orderBy("doc_id").limit(12).toPandas().text.tolist()
    changed = [(1000 + 10 * k + j, " ".join(w if i % (60 - 20 * j) else w + "x" for i, w in enumerate(words(t)))) for k, t in enumerate(base) for j in range(3)]
    table = docs.union(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in changed], docs.schema))
    rows = table.toPandas().sort_values("doc_id").reset_index(drop=True)
    sets = [shingles(t) for t in rows.text]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and sets[a]]
    label = closure(len(sets), linked)
    expected = {int(rows.doc_id[i]): int(rows.doc_id[label[i]]) for i in range(len(sets))}
    got = {r.doc_id: r.component_id for r in N.near_copy_groups(table).collect()}
    assert len(linked) > 20 and sum(got[i] != expected[i] for i in expected) <= 1
    kept = N.keep_one_of_each(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.select("doc_id").collect()} == set(got.values())
    left = N.keep_one_of_each(edges)
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert left.columns == edges.columns and sorted(str(i) for i in ids) == sorted(map(str, [1, 2, None, 5, 7, 8, 9, 10, -5])) and N.keep_one_of_each(empty).count() == 0


def test_shingles_of_all_texts_are_counted(spark):
    given = spark.range(41_000).selectExpr("id AS doc_id", "id AS content", "CASE WHEN id % 41 = 0 THEN 'one license line of all texts here' WHEN id % 41 < 40 THEN concat('text number ', id) END AS text")
    counts = N.bucket_counts(given, 5)
    often, _ = N.distinct_shingles(pa.array(["one license line of all texts here"]), 5)
    assert counts.sum() == 39_000 + 3 * 1_000 and (counts[(often >> np.uint64(64 - N.BUCKET_BITS)).astype(int)] >= 1_000).all()
    first = N.prefix_shingles(*N.distinct_shingles(pa.array(["one license line of all texts here and four words more"]), 5), counts, 0.5).to_pylist()[0]
    assert len(first) == 4 and not set(first) & set(often.view(np.int64).tolist())


def near_groups(spark, texts):
    """(groups by near_copy_groups, groups by brute force) of texts with ids 0, 1, ..."""
    sets = [shingles(t) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    found = {r.doc_id: r.component_id for r in N.near_copy_groups(frame(spark, list(enumerate(texts)))).collect()}
    return [found[i] for i in range(len(texts))], closure(len(texts), linked)


def test_near_copies_of_equal_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(N, "wide_fingerprints", lambda *x: np.zeros((len(x[1]) - 1, 2), np.uint64))
    tails = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    got, expected = near_groups(spark, [*tails, tails[0] + " more", tails[1].upper()])
    assert got == expected == [0, 1, 2, 3, 0, 1]


def test_near_copies_with_repeats(spark):
    texts = []
    for k in range(6):
        body = [f"b{k}x{i}" for i in range(400)]
        texts += [" ".join(body), " ".join(body + body[:40] * 5), " ".join(body + body[:20] * 30)]
    line = "this same line stands here again and again today "
    texts += [line * times + " ".join(f"{c}{i}" for i in range(n)) for times, n in ((60, 50), (200, 150)) for c in "cd"]
    got, expected = near_groups(spark, texts)
    assert got == expected and expected[:18] == [3 * (i // 3) for i in range(18)] and expected[18:] == [18, 19, 20, 21]


@pytest.mark.parametrize(("members", "rows"), [(6, N.BROADCAST_ROWS), (N.MEMBERS, 0)])
def test_near_copies_of_large_clusters_and_tables(spark, monkeypatch, members, rows):
    monkeypatch.setattr(N, "MEMBERS", members)
    monkeypatch.setattr(N, "BROADCAST_ROWS", rows)
    rng = np.random.default_rng(11)
    texts = []
    for k in range(3):  # chains of 25 versions, each a few words away from the one before
        w = [f"c{k}x{i}" for i in range(120)]
        for _ in range(25):
            texts.append(" ".join(w))
            for i in rng.integers(0, 120, 2).tolist():
                w[i] += "y"
    texts += [f"alone {i} " + " ".join(f"s{i}x{j}" for j in range(12)) for i in range(10)]
    got, expected = near_groups(spark, texts)
    assert got == expected and len(set(expected)) < len(texts) // 2


def test_near_copies_at_the_bound(spark):
    texts = []
    for k in range(150):  # pairs at 0.8 or little more: a tail cut off, some of them of very few shingles
        n = (5, 10, 45, 90, 250, 800)[k % 6]
        w = [f"p{k}x{i}" for i in range(n + 4)]
        texts += [" ".join(w), " ".join(w[: math.ceil(0.8 * n) + 4])]
    for k in range(50):  # and ends exchanged, 0.8 as well
        w = [f"q{k}x{i}" for i in range(94)]
        texts += [" ".join(w), " ".join(w[10:] + [f"r{k}x{i}" for i in range(10)])]
    got, expected = near_groups(spark, texts)
    assert expected == [i - i % 2 for i in range(len(texts))]
    assert got == expected


def brute_signature(text):
    points = [ord(c) for c in text]
    k = min(O.KMER, len(points))
    kmers = O.window_hashes(np.array(points, np.uint64) + np.uint64(1), k).tolist() if points else []
    if not kmers:
        return [0] * O.FUNCTIONS
    seen, elements = Counter(), []
    for x in kmers:
        mixed = O.mix64(np.array([(x + seen[x] * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]
        elements.append(int(mixed) >> 32)
        seen[x] += 1
    out = []
    for flip, times in zip(O._FLIP.ravel().tolist(), O._TIMES.ravel().tolist(), strict=True):
        order = sorted(range(len(kmers)), key=lambda i: ((elements[i] ^ flip) * times % 2**32, i))[: O.PICKED]
        h = np.zeros(1, np.uint64)
        for i in sorted(order):
            h = O.mix64(h * np.uint64(0x9E3779B97F4A7C55) + np.uint64(kmers[i]) + np.uint64(1))
        out.append(int(h[0]) >> 32)
    return out


def test_signature():
    for text in ("", "a", "abcabcabcabc", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "hello wörld 中文 " * 5, "xyz" * 3000):
        assert O.text_signature(text).tolist() == brute_signature(text)
    a = "the fox " * 3 + "jumped over it all and went home in the evening"
    assert O.likeness(O.text_signature(a), O.text_signature(a)) == 1
    assert O.likeness(O.text_signature(a * 4), O.text_signature(a * 4 + "!")) > 0.7


def test_order_minhash(spark, edges, empty):
    rows = sorted(((i, t or "") for i, t, *_ in EDGES), key=lambda r: (r[0] is None, -(r[0] or 0)))  # equal ids have equal texts here
    expected = []
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        expected.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), O.as_hex(O.text_signature(t)), O.as_hex(O.text_signature(edited)), O.likeness(O.text_signature(t), O.text_signature(after)), O.likeness(O.text_signature(t), O.text_signature(edited))))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_next, r.near_edited) for r in O.compare_with_edits(edges).collect()]
    assert sorted(got) == sorted(expected)
    many = [(i if i % 3 else (None if i % 2 else 7), f"text {i} " * (i % 5 + 1)) for i in range(1, 200)] + [(7, "same")] * 20
    got = O.compare_with_edits(frame(spark, many)).select("doc_id", "fingerprint", "near_next", "edited_sha256").collect()
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in many], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    ordered = sorted(many, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    expected = []
    for n, (i, t) in enumerate(ordered):
        after = ordered[(n + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        expected.append((str(i), O.as_hex(O.text_signature(t)), O.likeness(O.text_signature(t), O.text_signature(after)), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(expected)
    one = O.compare_with_edits(frame(spark, [(3, "abcdefgh" * 4)])).collect()
    assert len(one) == 1 and one[0].near_next == 1 and O.compare_with_edits(empty).count() == 0
    assert O.fingerprint_documents(edges).count() == len(EDGES)


@pytest.mark.parametrize(("head", "filter_bytes"), [(L.HEAD_WORDS, L.FILTER_BYTES), (3, L.FILTER_BYTES), (3, 0)])
def test_language_model(spark, edges, empty, monkeypatch, head, filter_bytes):
    monkeypatch.setattr(L, "HEAD_WORDS", head)
    monkeypatch.setattr(L, "FILTER_BYTES", filter_bytes)
    extra = [(100 + i, " ".join(f"v{(i * j) % 17} w{j}" for j in range(40))) for i in range(60)]
    docs = edges.union(frame(spark, extra))
    tokens = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, [*words((t or "").translate(LOWER)), None]) for i, t, *_ in [*EDGES, *extra]]
    learned = [["start", *ws] for _, out, ws in tokens if not out]
    counts = Counter(w for ws in learned for w in ws[1:])
    pairs = Counter(p for ws in learned for p in zip(ws, ws[1:], strict=False))
    n, v, starts = sum(counts.values()), len(counts), len(learned)

    def typical(own):
        by_level = {}
        for c in own.values():
            by_level.setdefault(int(L.levels_of(np.array([c]))[0]), []).append(c)
        means = {k: sum(x) / len(x) for k, x in by_level.items()}
        return {w: means[int(L.levels_of(np.array([c]))[0])] for w, c in own.items()}

    one, two, total = typical(counts), typical(pairs), n + 0.5 * (v + 1)

    def score(ws):
        out, before = 0.0, "start"
        for w in ws:
            context = starts if before == "start" else one.get(before, 0)
            out += math.log10((min(two.get((before, w), 0), context) + L.LEAN * (one.get(w, 0) + 0.5) / total) / (context + L.LEAN))
            before = w
        return out

    expected = [(i, out, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / total) for w in ws), score(ws)) for i, out, ws in tokens]
    got = L.score_documents(docs, bits=64).collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    for mine, right in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert mine[:5] == right[:5] and mine[5] == pytest.approx(right[5], abs=1e-4) and mine[6] == pytest.approx(right[6], abs=1e-4)
    assert L.score_documents(empty).count() == 0


def test_shards_score_as_one_filter_does(spark, sf, monkeypatch):
    whole = QUERIES["op8_bloom_lm"](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    monkeypatch.setattr(L, "FILTER_BYTES", 1000)
    parts = QUERIES["op8_bloom_lm"](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (whole.n_known == parts.n_known).all() and np.allclose(whole.base_score, parts.base_score, rtol=1e-12) and np.allclose(whole.score, parts.score, rtol=1e-12)


def test_filter_levels():
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(0, 2**63, 30000, dtype=np.uint64) * np.uint64(2))
    counts = np.maximum(1, (1 / rng.uniform(1e-6, 1, len(hashes))).astype(np.int64))
    levels = L.levels_of(counts)
    assert L.levels_of(np.array([1, 2, 3, 4, 5, 6, 8])).tolist() == [1, 2, 3, 4, 4, 5, 6]
    edges = L.segment_edges(hashes, 7)
    parts = {s: L.LogFrequencyFilter.part(hashes[edges[s] : edges[s + 1]], levels[edges[s] : edges[s + 1]]) for s in range(7)}
    filter_ = L.LogFrequencyFilter(parts, 7)
    held = filter_.levels(hashes)
    assert (held >= levels).all() and (held == levels).mean() > 0.97
    assert (filter_.levels(rng.integers(2**62, 2**63, 20000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) > 0).mean() < 0.03


def shuffled_rows(spark, after):
    """(rows that stages numbered above ``after`` sent to shuffles, the last stage's number)."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    found = [(stages.apply(i).stageId(), stages.apply(i).shuffleWriteRecords()) for i in range(stages.size())]
    return sum(n for k, n in found if k > after), max(k for k, _ in found)


@pytest.mark.parametrize("head", [0, 1 << 22])
def test_probes_do_not_multiply_with_segments(spark, monkeypatch, head):
    """A batch of texts asks ranges of segments: more segments make no more messages, and the scores stay."""
    rng = np.random.default_rng(8)
    docs = frame(spark, [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.3, 40) % 5000)) for i in range(300)]).repartition(4).localCheckpoint()
    monkeypatch.setattr(L, "FILTER_BYTES", 0)
    monkeypatch.setattr(L, "HEAD_WORDS", 50)
    monkeypatch.setattr(L, "HEAD_PAIRS", head, raising=False)
    monkeypatch.setattr(L, "TOGETHER", 1000)
    scores, rows = {}, {}
    for segments in (8, 100):
        monkeypatch.setattr(L, "segment_count", lambda *_, n=segments: n)
        scored = L.score_documents(docs, bits=64)
        _, last = shuffled_rows(spark, -1)
        scores[segments] = scored.toPandas().sort_values("doc_id").reset_index(drop=True)
        rows[segments], _ = shuffled_rows(spark, last)
    assert rows[100] - rows[8] <= 92 * 2  # the model's rows, one for each n and segment
    assert (scores[8].n_known == scores[100].n_known).all() and np.allclose(scores[8].base_score, scores[100].base_score, rtol=1e-12) and np.allclose(scores[8].score, scores[100].score, rtol=1e-4)


@pytest.mark.parametrize("at_once", [L.AT_ONCE, 40])
def test_parts_look_up_many_batches_at_once(monkeypatch, at_once):
    rng = np.random.default_rng(2)
    hashes = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    counts = rng.integers(1, 100, len(hashes))
    edges, rows, sent = L.segment_edges(hashes, 6), [], {}
    for n in (1, 2):
        for s in range(6):
            own, c = hashes[edges[s] : edges[s + 1]], counts[edges[s] : edges[s + 1]]
            exact = (L.pack(own), L.pack(c)) if n == 1 else (None, None)
            rows.append((-1, n, s // 3, exact[0], s, exact[1], L.LogFrequencyFilter.part(own, L.levels_of(c), 64).tobytes()))
        for b in range(200):
            probes = np.append(rng.choice(hashes, 10), rng.integers(0, 2**64, 3, dtype=np.uint64))
            for r in range(2):
                sent[b, n, r] = probes[L._ranges_of(probes, 6, 2) == r]
                rows.append((b, n, r, L.pack(sent[b, n, r]), None, None, None))
    rows.append((5, 0, 5, b"own", None, None, None))
    rows.sort(key=lambda r: (r[1], r[2], r[0]))
    schema = pa.schema([("batch", pa.int64()), ("n", pa.int32()), ("range", pa.int64()), ("packed", pa.binary()), ("segment", pa.int32()), ("counts", pa.binary()), ("part", pa.binary())])
    table = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
    calls, look_up = [], L.LogFrequencyFilter.levels
    monkeypatch.setattr(L, "AT_ONCE", at_once)
    monkeypatch.setattr(L.LogFrequencyFilter, "levels", lambda self, x: calls.append(len(x)) or look_up(self, x))
    answers = [r for batch in L._answered(iter(table.to_batches(max_chunksize=90)), 6) for r in batch.to_pylist()]
    assert [r["packed"] for r in answers if r["n"] == 0] == [b"own"]
    got = {(r["batch"], r["n"], r["range"]): pickle.loads(r["packed"]) for r in answers if r["n"]}
    held = dict(zip(hashes.tolist(), counts.tolist(), strict=True))
    assert got.keys() == sent.keys() and len(calls) <= 4 + 2 * 200 * 13 // at_once
    for (_, n, _), (key, probes) in zip(sent, sent.items(), strict=True):
        exact, levels = got[key]
        known = np.array([held.get(h, 0) for h in probes.tolist()], np.int64)
        assert L.unpack(exact, np.int64).tolist() == (known.tolist() if n == 1 else [])
        assert (L.unpack(levels, np.uint8) == L.levels_of(known)).all()


def test_frequent_pairs():
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    counts = rng.permutation(len(hashes)) + 1
    pairs = L.FrequentPairs(hashes, counts, L.levels_of(counts).astype(np.uint8))
    found = pairs.levels(hashes)
    here = found != L.ASKED
    assert (found[here] == L.levels_of(counts)[here]).all() and here.mean() > 0.7 and counts[here].mean() > counts[~here].mean()
    assert (pairs.levels(rng.integers(0, 2**64, 1000, dtype=np.uint64)) == L.ASKED).all()
    assert (L.FrequentPairs(hashes[:0], counts[:0], np.zeros(0, np.uint8)).levels(hashes) == L.ASKED).all()


def test_model_beats_base_on_held_out(spark, sf):
    r = QUERIES["op8_bloom_lm"](spark, sf).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


@pytest.mark.parametrize("block", [K.BLOCK, 64])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (300, 8)).astype(np.float32)
    x[:60] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [float("nan")] * 8), (502, [None] * 8), (None, x[0].tolist())]
    rows += [(40, x[5].tolist()), (40, x[6].tolist()), (40, x[6].tolist()), (80, (-x[7]).tolist()), (503, [0.0] * 8), (520, [0.0] * 8), (560, [0.5] * 3), (561, [])]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<float>, score string")
    vectors = K.whole_vectors(df)
    whole = [(i, np.append(np.floor(64 * np.array(v, np.float64)), np.zeros(8 - len(v)))) for i, v in rows if i is not None and v is not None and None not in v and not np.isnan(v).any()]
    expected = []
    for n, (i, q) in enumerate(whole):
        if i % 20 == 0:
            best = sorted((-int(v @ q), j) for m, (j, v) in enumerate(whole) if m != n)[:20]
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, K.top_k(vectors, F.col("id") % 20 == 0).collect())) == sorted(expected)
    assert K.top_k(vectors.limit(0), F.lit(True)).count() == 0
    assert K.top_k(vectors.where("id < 3"), F.col("id") == 0).count() == 2 and K.top_k(vectors.where("id = 3"), F.lit(True)).count() == 0


def test_top_k_prunes(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 256)
    rng = np.random.default_rng(5)
    x = np.floor(rng.exponential(4, (2000, 1)) ** 2 * np.array([9, 3, 1, 1]) + rng.uniform(0, 3, (2000, 4))).astype(int)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<long>").withColumns({"row": F.col("id"), "block": (F.col("id") % 8).cast("int")})
    asked = vectors.where("id % 20 = 0").withColumn("floor", F.lit(K._NO_FLOOR))
    scored = K._met(vectors, asked, 8, 20).agg(F.sum("scored")).first()[0]
    assert 100 * 20 <= scored < 0.7 * 100 * 250


def test_mixing(spark, edges, empty):
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 7}" if i % 7 else None) for i in range(700)] + [(900, None, "void"), (901, "one two", "s1"), (901, "one two", "s1")]
    plan = M.mix_plan(frame(spark, rows)).toPandas()
    assert len(plan) == len(rows) and (plan.times <= 2).all()
    total = plan["size"].sum()
    by = plan.assign(taken=plan["size"] * plan.times, source=plan.source.fillna("~")).groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), least=("times", "min"), most=("times", "max"))
    assert (by["size"] == by.source_size).all() and by.target.sum() == pytest.approx(1.5 * total)
    assert (by.target <= 2 * by.source_size + 1e-9).all() and (abs(by.taken - by.target) <= 40).all() and (by.most - by.least <= 1).all()
    open_ = by[by.target < 2 * by.source_size - 1e-9]
    weight = pd.Series([M.WEIGHTS[i % 3] for i in range(len(by))], index=by.index)
    assert np.allclose((open_.target / weight[open_.index]).to_numpy(), (open_.target / weight[open_.index]).iloc[0])
    mixed = M.mix_documents(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns and mixed.count() == plan.times.sum()
    again = M.mix_plan(frame(spark, rows[::-1])).toPandas()
    assert plain(again) == plain(plan)
    assert M.mix_plan(empty).count() == M.mix_documents(empty).count() == 0 and M.mix_plan(edges).count() == len(EDGES)


def test_quality(spark, edges, empty):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        text = " ".join(rng.choice(vocabulary, 60))
        kind = i % 6
        if kind == 0:
            text = " ".join(w + "%%%" for w in text.split())
        elif kind == 1:
            text += " idiot moron"
        rows.append((i, text))
        labels.append((i, int(kind != 0), int(kind == 1)))
    docs = frame(spark, rows)
    known = spark.createDataFrame([r for r in labels if r[0] % 7] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit_quality(docs, known)
    out = Q.score_quality(docs, model)
    assert out.columns == [*docs.columns, "text_score", "meta_score", "score_", "keep"]
    kept = {r.doc_id: r.keep for r in out.collect()}
    held = [i for i in kept if i % 7 == 0]
    assert np.mean([kept[i] == (i % 6 > 1) for i in held]) > 0.97
    assert Q.score_quality(edges, model).count() == len(EDGES) and Q.score_quality(empty, model).count() == 0
    blank = Q.score_quality(docs, Q.fit_quality(empty, known.limit(0))).agg(F.min("score_"), F.max("score_")).first()
    assert tuple(blank) == (0.5, 0.5)
    Q.fit_quality(edges, spark.createDataFrame([(1, 1, 0), (7, 0, 0), (10, 1, None)], "doc_id long, quality int, toxic int"))


def brute_features(text, lang, source):
    """(text buckets, metadata) of one document in plain loops."""
    raw = (text or "").encode()
    tokens = re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x20\x09-\x0d]+", raw.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    is_word = [t[0] >= 128 or chr(t[0]).isalnum() for t in tokens]

    def hashed(b):
        return int(L.word_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])

    buckets = sorted({hashed(t) >> (64 - Q.TEXT_BITS) for t in tokens})
    n, k = max(len(raw), 1), max(sum(is_word), 1)
    signs = sum(len(t) for t, w in zip(tokens, is_word, strict=True) if not w)
    repeats = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    dense = [math.log1p(len(raw)), signs / n, sum(48 <= c <= 57 for c in raw) / n, sum(65 <= c <= 90 for c in raw) / n, sum(c == 32 or 9 <= c <= 13 for c in raw) / n, sum(c >= 128 for c in raw) / n, raw.count(b"\n") / k]
    dense += [sum(is_word) / n, sum(len(t) > 1 for t, w in zip(tokens, is_word, strict=True) if not w) / k, repeats / k, len(buckets) / max(len(tokens), 1), float(not raw)]
    names = np.zeros(2 * Q.NAME_BUCKETS)
    for i, name in enumerate((lang, source)):
        names[i * Q.NAME_BUCKETS + (hashed(name.encode()) % (Q.NAME_BUCKETS - 1) + 1 if name else 0)] = 1
    return buckets, np.append(dense, names)


def test_quality_by_brute_force(spark, sf, edges):
    """Every score of the query from features in plain loops and the model's coefficients; kept documents are those of a half or more."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = Q.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    plain_rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    expected = {}
    for i, text, lang, source in plain_rows:
        buckets, meta = brute_features(text, lang, source)
        a = sum(model.text[model.slot[b]] for b in buckets if model.slot[b] < len(model.text) - 1) + model.text[-1]
        b = sum((x - c) / d * w for x, c, d, w in zip(meta, model.center, model.spread, model.meta, strict=False)) + model.meta[-1]
        a, b = a * model.text_scale[0] + model.text_scale[1], b * model.meta_scale[0] + model.meta_scale[1]
        expected[i] = [1 / (1 + math.exp(-min(max(x, -30), 30))) for x in (a, b, model.blend[0] * a + model.blend[1] * b + model.blend[2])]
    got = {r.doc_id: r for r in QUERIES["op1_quality"](spark, sf).collect()}
    assert got.keys() == expected.keys()
    for i, r in got.items():
        assert [r.text_score, r.meta_score, r.score] == pytest.approx(expected[i], abs=1e-9) and r.keep == (r.score >= 0.5)
    assert Q.fit_quality(edges, spark.createDataFrame([(1, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")) is not None


def test_views_teach_each_other(spark):
    """Words that only unlabelled documents hold get their sign from the metadata view."""
    rows, labels = [], []
    rng = np.random.default_rng(4)
    for i in range(3000):
        good, late = i % 2 == 0, i >= 1500
        words_ = rng.choice([f"{'late' if late else 'soon'}{'good' if good else 'evil'}{k}" for k in range(14)], 7)
        rows.append((i, " ".join(words_), "site a" if good else "site b"))
        if not late:
            labels.append((i, int(good), 0))
    docs = frame(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    taught = {r.doc_id: r.text_score for r in Q.score_quality(docs, Q.fit_quality(docs, known)).where("doc_id >= 1500").collect()}
    assert np.mean([(p >= 0.5) == (i % 2 == 0) for i, p in taught.items()]) > 0.95


def test_rerun_gives_the_same_plan_of_copies(spark, sf):
    a, b = (QUERIES["op10_mixing"](spark, sf).agg(F.sum(F.hash("doc_id", "taken"))).first()[0] for _ in range(2))
    assert a == b


def test_likeness_falls_with_edit_distance(spark, monkeypatch):
    """Order MinHash is about order and edits: more edits are less alike, and moved blocks too, though they hold nearly the same k-mers."""
    import random

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(4)
    falls = []
    for _ in range(12):
        text = "".join(rng.choices("abcdefghij ", k=400))
        seen = []
        for n in (0, 4, 16, 64, 300):
            other = list(text)
            for _ in range(n):
                at = rng.randrange(len(other))
                how = rng.randrange(3)
                other[at : at + (how != 1)] = [rng.choice("abcdefghij ")] if how else []
            other = "".join(other)
            seen.append((edits(text, other), O.likeness(O.text_signature(text), O.text_signature(other))))
        assert seen[0] == (0, 1.0) and [d for d, _ in seen] == sorted(d for d, _ in seen)
        falls.append([s for _, s in seen])
        half = text[200:] + text[:200]  # nearly all k-mers, another order
        assert O.likeness(O.text_signature(text), O.text_signature(half)) < 0.8
    means = np.mean(falls, axis=0)
    assert (np.diff(means) < 0).all() and means[-1] < 0.05
    monkeypatch.setattr(O, "RANGE_BYTES", 200)
    monkeypatch.setattr(O, "MOST_RANGES", 3)
    docs = frame(spark, [(i, "".join(rng.choices("abcde ", k=60))) for i in range(80)])
    few = sorted(map(tuple, O.compare_with_edits(docs).collect()))
    monkeypatch.setattr(O, "MOST_RANGES", 50)
    assert sorted(map(tuple, O.compare_with_edits(docs).collect())) == few and len(few) == 80


@pytest.mark.parametrize(("given", "most"), [(0.1, 10**6), (0.5, 96), (0.0001, 10**6)])
def test_labels_that_views_give(spark, sf, monkeypatch, given, most):
    """Of each view and kind the surest texts, a share of all, each once; surer ones before others."""
    import pyarrow as pa

    monkeypatch.setattr(Q, "GIVEN", given)
    monkeypatch.setattr(Q, "MOST_GIVEN", most)
    monkeypatch.setattr(Q, "SURE", 0.6)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(0)
    width = Q.features(pa.array([""]), pa.array([""]), pa.array([""]))[2].shape[1]
    model = Q.QualityModel(np.arange(1 << Q.TEXT_BITS, dtype=np.int32) % 999, rng.normal(0, 0.1, 1000), rng.normal(0, 0.1, width + 1), np.zeros(width), np.ones(width), Q._PLAIN, Q._PLAIN, np.zeros(3))
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    text, meta, _ = model.scores(*Q.features(*(pa.array([r[c] for r in rows], pa.string()) for c in ("text", "lang", "source"))))
    first = {}
    for i, r in enumerate(rows):
        first[r.text] = min(first.get(r.text, (r.doc_id, i)), (r.doc_id, i))
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text", "lang", "source")
    got = {}
    for r in Q._surest(taken, model).collect():
        got.setdefault((r.view, r.good), set()).add(r.doc_id)
    number = min(math.ceil(given * len(first)), most // (4 * Q.ROUNDS))
    for view, p in (("meta", text), ("text", meta)):  # each view labels for the other
        x = {d: np.log(p[i] / (1 - p[i])) for d, i in first.values()}
        for good in (True, False):
            sure = {d: int(abs(v) * Q.STEPS) for d, v in x.items() if (v > 0) == good and int(abs(v) * Q.STEPS) >= math.ceil(math.log(0.6 / 0.4) * Q.STEPS)}
            own = got.get((view, good), set())
            assert own <= sure.keys()
            steps = sorted(sure.values(), reverse=True)
            last = steps[min(number, len(steps)) - 1] if steps else 0
            assert {d for d, s in sure.items() if s > last} <= own and all(sure[d] >= last for d in own)
            assert abs(len(own) - min(number, len(steps))) <= sum(s == last for s in steps)
