"""Secret scans (operator 5): an Aho-Corasick pass finds keywords, anchored patterns run only at its hits, checksums confirm.

Spans are in code points, ends exclusive. Kinds: ``assign`` (a secret's name, a sign and a value),
``access`` (access key ids), ``hex`` (long runs of lower-case hexadecimal digits), and three kinds
whose checksum must hold: ``github`` and ``npm`` (tokens that end in the CRC-32 of their body in base
62) and ``wif`` (private keys in base 58 with a double SHA-256 check).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.llm.common import map_whole, small_batches, text_pieces

KINDS = ("assign", "access", "hex", "github", "npm", "wif")
BASE_KINDS = KINDS[:3]
#: Names that an assigned secret goes by, and prefixes of tokens with a checksum.
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
GITHUB = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
WIF = ("5h", "5j", "5k")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

#: Anchored at a hit; a kind's match counts when its group 1 has the least length.
PATTERNS = {
    "assign": (re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 12),
    "access": (re.compile(r"(AKIA[A-Z0-9]+)"), 18),
    "hex": (re.compile(r"([0-9a-f]+)"), 16),
    "github": (re.compile(r"(gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"), 40),
    "npm": (re.compile(r"(npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])"), 40),
    "wif": (re.compile(r"(?<![A-Za-z0-9])(5[HJK][1-9A-HJ-NP-Za-km-z]{49})(?![A-Za-z0-9])"), 51),
}
_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Every run of enough hexadecimal digits begins with one of the 16**4 words of four digits.
_HEX_WORD = 4


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("assign", NAMES), ("access", ("akia",)), ("github", GITHUB), ("npm", ("npm_",)), ("wif", WIF)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    for word in product("0123456789abcdef", repeat=_HEX_WORD):
        found.add_word("".join(word), ("hex", _HEX_WORD))
    found.make_automaton()
    return found


def _crc_holds(token: str) -> bool:
    body, check = token[4:34], token[34:]
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.rjust(6, "0") == check


def _wif_holds(key: str) -> bool:
    value = 0
    for c in key:
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes(38, "big")  # 51 digits from 5H on fit 37 bytes: version, key, check
    return raw[:2] == b"\x00\x80" and hashlib.sha256(hashlib.sha256(raw[1:34]).digest()).digest()[:4] == raw[34:]


CHECKS = {"github": _crc_holds, "npm": _crc_holds, "wif": _wif_holds}


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret, by start and then in the order of KINDS; per kind leftmost and non-overlapping."""
    low = text.lower()
    if len(low) != len(text):  # some capitals have longer small letters
        low = text.translate(_TO_LOWER)
    past = dict.fromkeys(KINDS, 0)
    spans = []
    for last, (kind, length) in _automaton().iter(low):
        start = last + 1 - length
        if start < past[kind]:
            continue
        pattern, least = PATTERNS[kind]
        m = pattern.match(text, start)
        if m is None:
            continue
        past[kind] = m.end()
        if m.end(1) - m.start(1) >= least and (kind not in CHECKS or CHECKS[kind](m[1])):
            spans.append((kind, m.start(), m.end()))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """``text`` with every stretch covered by spans replaced by one ``mask``."""
    out, at, stop = [], 0, 0
    for _, start, end in spans:
        if start >= stop and start >= at:
            out += [text[at:start], mask]
        stop = max(stop, end)
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets in its texts replaced by ``mask``; all rows and columns stay, ``n_chars`` (if there) is counted anew.

    Null texts stay null, texts without secrets stay as they are; repeated rows each give a row, an empty table gives none; null ids
    and columns of any names stay. Nothing is shuffled.
    """
    at = docs.columns.index(text_col)

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in text_pieces(batches, f"c{at}"):
            texts = [x if x is None else redacted(x, find_secrets(x), mask) for x in batch.column(at).to_pylist()]
            columns = [*batch.columns]
            columns[at] = pa.array(texts, pa.string())
            yield columns

    out = map_whole(docs, masked, [])
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``spans`` (array of kind, start, end) over its whole text.

    A null text has no spans; a null id is kept; repeated rows each give a row; other columns are not read.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in text_pieces(batches):
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_secrets(x or "")] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(scanned, "id long, spans array<struct<kind string, start long, end long>>").withColumnRenamed("id", id_col)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
