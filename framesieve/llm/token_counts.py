"""Token counts (operator 2): batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.llm.common import small_batches, text_pieces

#: One call of the library encodes about so many characters; lengths of pieces kept per worker, and the longest piece kept.
CALL_CHARS, CACHE_PIECES, CACHE_CHARS = 1 << 19, 300_000, 48
#: Context length that ``over_limit`` compares with.
LIMIT = 512

#: Between a sign that is no white space and one that is; the second only where white space is the same for all libraries.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r\x0b\x0c])")
#: Pieces from so many characters on are cut on, where a run of ASCII letters ends.
LONG = 2048
_LETTERS_END = re.compile(r"(?<=[A-Za-z])(?=[\x21-\x40\x5b-\x60\x7b-\x7e])")
_loaded: dict[str, object] = {}
_lengths: dict[str, dict[str, int]] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def safe_pieces(text: str) -> list[str]:
    """``text`` cut before white space behind other signs; pieces of LONG characters also where ASCII letters end.

    A byte-level pre-tokeniser always starts a new token there, whatever stands before (only its tokens of white space look ahead, and only at what follows
    them), and no special token holds such a place, so the pieces' token counts add up to the text's. A text without such places stays whole.
    """
    pieces = _SAFE.split(text)
    if max(map(len, pieces)) < LONG:
        return pieces
    return [part for piece in pieces for part in ([piece] if len(piece) < LONG or "<|" in piece else _LETTERS_END.split(piece))]


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


def text_lengths(texts: list[str], path: str) -> list[int]:
    """The number of tokens of each text. Pieces whose length is not known yet go to the library, each once,
    in batches of about CALL_CHARS characters."""
    tokenizer, known = _tokenizer(path), _lengths.setdefault(path, {})
    if len(known) > CACHE_PIECES:
        known.clear()
    cut = [safe_pieces(text) for text in texts]
    fresh = list({piece for pieces in cut for piece in pieces if piece not in known})
    lengths: dict[str, int] = {}
    at = 0
    while at < len(fresh):
        to, chars = at, 0
        while to < len(fresh) and chars < CALL_CHARS:
            chars += len(fresh[to])
            to += 1
        for piece, encoding in zip(fresh[at:to], tokenizer.encode_batch_fast(fresh[at:to], add_special_tokens=False), strict=True):
            (known if len(piece) <= CACHE_CHARS else lengths)[piece] = len(encoding)
        at = to
    return [sum(known[x] if x in known else lengths[x] for x in pieces) if lengths else sum(map(known.__getitem__, pieces)) for pieces in cut]


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    A null text counts as the empty one (0 bytes, 0 tokens); a null id is kept; repeated rows each
    give a row; other columns of ``docs`` are not read; an empty table gives no row. The plan is a
    scan of two columns and a map: nothing is shuffled, and only lengths leave Python.
    """
    path = tokenizer or default_tokenizer()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches):
            counts = text_lengths([x or "" for x in batch.column(1).to_pylist()], path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = given.mapInArrow(lengths, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
