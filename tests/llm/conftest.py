import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, hash long, kept string, size long, part int, score double, token_ids string, id string"


def frame(spark, rows):
    """rows: (doc_id, text[, source]); further columns have names that operators use inside."""
    full = [(i, t, "en", s[0] if s else "src0", len(t) if t is not None else None, 1, 2, "x", 3, 4, 0.5, "y", "z") for i, t, *s in rows]
    return spark.createDataFrame(full, COLUMNS)


EDGES = [
    (1, "the quick brown fox jumps over the lazy dog and runs away"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (None, "a text without an id"),
    (5, "short"),
    (6, "the quick brown fox jumps over the lazy dog and runs away"),
    (6, "the quick brown fox jumps over the lazy dog and runs away"),
    (7, "ünïcödé wörds and 中文字 don't we'll I'VE 12345 ½ 🙂🙂 <|endoftext|> x"),
    (8, "word " * 30000),
    (9, "x" * 120000),
    (10, "Ünïcode İstanbul password=abcdefghijkl0123 " + " ".join(f"w{i}" for i in range(400))),
    (11, " ".join(f"w{i}" for i in range(400)) + " tail"),
    (-5, "negative ids come first " + " ".join(f"w{i}" for i in range(50, 90))),
    (12, None, None),
]


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, EDGES)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, EDGES[:1]).limit(0)
