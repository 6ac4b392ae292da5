"""Operators 11 to 13 against brute force, SQL and edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from framesieve.llm import lexical_search as X
from framesieve.llm import suffix_dedup as U
from framesieve.llm import token_alignment as A
from framesieve.llm.common import lower_ascii
from framesieve.llm.queries import QUERIES
from tests.llm.conftest import EDGES, frame

ODD = ["a▁b c", "▁", "x ▁ y", "<|endoftext|> <s> </s> <0x41> <unk>", "  two  blanks ", "\tx\n\n y\r\nz ", "\x00\x01 \x02", "　wide \xa0hard", "é é ﬁ Ａ", "\U0001f642‍\U0001f642 z", "don't WE'LL 12345 1,000.5", "a" * 300, "nospace" * 2000, "line\n" * 500, "中文字 中文"]


def aligned(texts):
    """Each text's (a ids, b ids, groups, links) by whole encodings and a walk over bytes; None without tokens."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ta.encode_special_tokens = True
    known = A._aligner(*A.default_tokenizers())
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        a, b, raw = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text), (" " + text).encode()
        if b"".join(known.bytes_a[i] for i in a) != raw or b"".join(known.bytes_b[i] for i in b) != raw:
            out.append(None)
            continue
        ends, at = {}, 0
        for n, i in enumerate(a):
            at += len(known.bytes_a[i])
            ends[at] = n
        groups, links, at, la, lb = [], [], 0, 0, 0
        for n, i in enumerate(b):
            at += len(known.bytes_b[i])
            if at in ends:
                m = ends[at]
                groups.append(",".join(map(str, a[la : m + 1])) + "|" + ",".join(map(str, b[lb : n + 1])))
                links.append((a[m], i))
                la, lb = m + 1, n + 1
        out.append((a, b, groups, links))
    return out


@pytest.mark.parametrize(("heavy", "cache"), [(A.HEAVY, A.CACHE_PIECES), (40, 5)])
def test_alignment_by_brute_force(spark, monkeypatch, heavy, cache):
    monkeypatch.setattr(A, "HEAVY", heavy)
    monkeypatch.setattr(A, "CACHE_PIECES", cache)
    monkeypatch.setattr(A, "HELD_PAIRS", 50)
    rng = random.Random(heavy + cache)
    signs = list("aeT'. \n\t0é中▁\U0001f642") + ["the", " in", " and", "ing "]
    texts = [t for _, t, *_ in EDGES] + ODD + ["".join(rng.choices(signs, k=rng.randrange(1, 60))) for _ in range(150)]
    df = frame(spark, [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]).repartition(5)
    want = aligned(texts)
    counts = Counter(link for w in want if w for link in w[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for i, w in enumerate(want):
        facts = (0, 0, 0, 0, 0, 0, "") if w is None else (len(w[0]), len(w[1]), len(w[2]), len(w[3]), sum(counts[x] == best[x[1]] for x in w[3]), sum(counts[x] for x in w[3]), hashlib.sha256(";".join(w[2]).encode()).hexdigest())
        rows.append((str(None if i == 3 else i // 2), *facts))
    got = [(str(r[0]), *tuple(r)[1:]) for r in A.align_corpus(df).collect()]
    assert sorted(got) == sorted(rows) and any(w is None and t for w, t in zip(want, texts, strict=True))
    assert {(r.a, r.b): r["count"] for r in A.count_links(df).collect()} == counts
    shown = sorted((str(r.doc_id), r.n_a, r.groups) for r in A.align_texts(df).collect())
    assert shown == sorted((str(None if i == 3 else i // 2), len(w[0]) if w else 0, ";".join(w[2]) if w else "") for i, w in enumerate(want))


def test_alignment_of_an_empty_table(spark, empty):
    assert A.align_corpus(empty).count() == 0 and A.align_texts(empty).count() == 0 and A.count_links(empty).count() == 0


def searched(docs, items, k):
    """Ranks by scoring every document."""
    import re

    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    held = [(i, Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(term.findall((text or "").translate(lower))), []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(times * int(np.floor(1000 * np.log((2 * n + 2) / (2 * df[t] + 1)))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(str(item), r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "the quick brown FOX the"), (2, None), (3, ""), (None, "w1 w2 w399 tail"), (4, "ÜNÏ wörds 12345 ünïcödé"), (4, "ÜNÏ wörds 12345 ünïcödé"), (5, "nowhere at all qqq"), (6, "x" * 120000 + " word"), (7, " ".join(f"w{i % 60}" for i in range(300)))]


@pytest.mark.parametrize(("block", "first", "cells", "load"), [(X.BLOCK_BYTES, X.FIRST, X.BOUND_CELLS, X.LOAD), (60000, 1, 50, 1)])
def test_search_by_brute_force(spark, monkeypatch, block, first, cells, load):
    monkeypatch.setattr(X, "FIRST", first)
    monkeypatch.setattr(X, "BOUND_CELLS", cells)
    monkeypatch.setattr(X, "LOAD", load)
    rng = random.Random(1)
    docs = [r[:2] for r in EDGES] + [(100 + i, " ".join(rng.choices([f"w{j}" for j in range(80)], k=rng.randrange(1, 90)))) for i in range(150)] + [(500 + i, "w1 w2 w3 the") for i in range(40)]
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, query long").repartition(3)
    got = X.search(frame(spark, docs).repartition(4), items, 7, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(((str(r.item_id), r.rank, r.doc_id, r.score) for r in got.collect()), key=str) == searched(docs, ITEMS, 7)


def test_search_in_empty_tables(spark, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert X.search(empty, items).count() == 0 and X.search(frame(spark, EDGES), items.limit(0)).count() == 0


def test_sketches_are_bounds_that_spare_scores(monkeypatch):
    import pyarrow as pa

    rng = random.Random(0)
    texts = [" ".join(rng.choices([f"t{j}" for j in range(3000)], k=120)) for _ in range(400)]
    terms = X._terms(pa.array(texts))
    impacts = X._impact(terms.tf, np.full(len(terms.tf), 100))
    sketches = X.Sketches(terms, impacts)
    own = sketches.bounds(np.arange(len(texts)), np.unique(terms.hashes))
    exact = np.zeros_like(own)
    exact[terms.owner, np.searchsorted(np.unique(terms.hashes), terms.hashes)] = impacts
    assert (own >= exact).all() and (own == exact).mean() > 0.8
    scored, scores = [], X._scores
    monkeypatch.setattr(X, "_scores", lambda d, *rest: scored.append(len(d)) or scores(d, *rest))
    queries = X._Queries.of([1, 2], pa.array([texts[7], texts[9]]))
    X._search_batch(np.arange(len(texts)), terms, np.full(len(texts), 100), queries, np.ones(len(queries.places), np.int64), X._Best(2, 1))
    assert sum(scored) < 0.3 * 2 * len(texts)


def without_repeated_bytes(rows, length=200):
    """(id, bytes, removed, spans, kept) by counting every string of every row."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, np.int32)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((str(i), len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


def repeating(seed):
    """Documents that share passages of many lengths, whole or by parts, at edges, with one byte changed, over and over."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé中 ", k=rng.randrange(2, 9)))
    passage = [" ".join(word() for _ in range(n)) for n in (20, 35, 36, 40, 60, 120)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passage)
            cut = rng.choice([0, 1, 5, 60])
            p = p[cut : len(p) - rng.choice([0, 1, 30])]
            parts.append(p if rng.random() < 0.7 else p[:90] + "#" + p[91:])
            parts.append(" ".join(word() for _ in range(rng.choice([0, 1, 3, 30]))))
        rows.append((i, "".join(parts)))
    rows += [(100 + i, "hot start " * (i % 2) + str(i) + passage[-1] + str(i)) for i in range(40)]
    return rows + [(200, "ab" * 300), (201, "line of text\n" * 40), (202, "x" * 199), (203, "x" * 200), (204, "y" * 201), (205, "0" * 150 + "1" * 150)]


@pytest.mark.parametrize(("hot", "ranges", "held", "seed"), [(U.HOT, U.RANGE_BYTES, U.HELD_SEGMENTS, 1), (4, 60000, 40, 2), (10**9, 60000, 40, 4)])
def test_suffix_dedup_by_brute_force(spark, monkeypatch, hot, ranges, held, seed):
    for name, value in (("HOT", hot), ("RANGE_BYTES", ranges), ("HELD_SEGMENTS", held), ("HELD_STRINGS", 10 * held), ("HELD_ANCHORS", 10 * held)):
        monkeypatch.setattr(U, name, value)
    rows = [r[:2] for r in EDGES] + repeating(seed)
    got = U.drop_repeated_bytes(frame(spark, rows).repartition(6))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == without_repeated_bytes(rows)


def test_suffix_dedup_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(U, "FILTER_BYTES", 200)
    rows = repeating(3)
    got = U.drop_repeated_bytes(frame(spark, rows))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == without_repeated_bytes(rows)


def test_suffix_dedup_without_repeats(spark, empty):
    assert U.drop_repeated_bytes(empty).count() == 0
    rows = [(i, f"{i} " * 90) for i in range(9)] + [(None, None)]
    assert sorted((str(r.doc_id), r.n_removed) for r in U.drop_repeated_bytes(frame(spark, rows)).collect()) == sorted((i, n) for i, _, n, _, _ in without_repeated_bytes(rows))


def test_interleave_is_the_order_of_the_strings():
    rng = np.random.default_rng(2)
    strings = rng.integers(0, 3, (300, 12)).astype(np.uint8)
    strings[50:90] = strings[7]
    blocks = rng.integers(0, 5, 300)
    order, prefix = U.refine_interleave(np.ascontiguousarray(strings.T), blocks)
    keys = [(blocks[i], bytes(strings[i])) for i in order]
    assert keys == sorted(keys)
    for a, b, n in zip(order, order[1:], prefix[1:], strict=False):
        same = strings[a] == strings[b]
        assert n == (-1 if blocks[a] != blocks[b] else 12 if same.all() else int(same.argmin()))


def test_queries_read_whole_tables(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert QUERIES["op11_token_alignment"](spark, sf).count() == documents and QUERIES["op13_suffix_dedup"](spark, sf).count() == documents
    found = QUERIES["op12_lexical_search"](spark, sf)
    assert found.count() == 10 * spark.read.parquet(f"{sf}/benchmark.parquet").count()


def test_lower_case_is_ascii_alone():
    assert lower_ascii(np.frombuffer("AÉZ[".encode(), np.uint8)).tobytes().decode() == "aÉz["
