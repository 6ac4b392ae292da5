"""The corpus pipeline: documents through five stages, each stage's rows kept as Parquet in between.

Every stage reads whole texts of all rows it is given, and all but the last return the columns of their input as they
were, whatever their names (own columns get names that no input column has). Nulls may stand in any column.
Repeated rows are rows of their own except where a stage says otherwise. A table without rows gives none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.llm.byte_bpe import encode_documents
from framesieve.llm.common import quoted, remove_folder, shared_folder, small_batches, unused
from framesieve.llm.mixing import mix_documents
from framesieve.llm.near_copies import keep_one_of_each
from framesieve.llm.quality import fit_quality, score_quality
from framesieve.llm.secrets import redact_secrets


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds good (score of 0.5 or more).

    Null or empty text, language and source count as empty and are scored like others; null ids are scored but teach nothing; equal rows get
    equal scores; very long texts are scored whole. Without labels all score 0.5 and stay.
    """
    small_batches(spark)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model)
    return scored.where(F.col(quoted(scored.columns[-1]))).select(*map(quoted, docs.columns))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one of least id.

    Null ids come after all others. Texts without words (null, empty, white space) are one group. Rows equal in id and text are one
    document; of rows equal in id only, the one whose text has the smaller hash comes first. Texts of any length are compared whole.
    """
    small_batches(spark)
    return keep_one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; ``n_chars``, if there, is counted anew.

    Null texts stay null, texts without secrets stay as they are; overlapping secrets get one mask.
    """
    small_batches(spark)
    return redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (0 to 2 times).

    Null is a source of its own; a null text has no words; rows equal in id and text are taken alike.
    """
    small_batches(spark)
    return mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens, token_ids, token_offsets (bytes at which tokens start, the length last) and round_trip (whether decoding gives the text back).

    A null text is encoded as the empty one. Where a document column has such a name already, the new column gets underscores behind it.
    """
    small_batches(spark)
    tokens = encode_documents(docs)
    ids, offsets, decoded = (F.col(quoted(c)) for c in tokens.columns[len(docs.columns) :])
    names = unused(["n_tokens", "token_ids", "token_offsets", "round_trip"], docs.columns)
    whole = decoded == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    added = [c.alias(n) for c, n in zip((F.size(ids).cast("long"), ids, offsets, whole), names, strict=True)]
    return tokens.select(*map(quoted, docs.columns), *added)


STAGES = [
    ("quality", good_documents),
    ("near_dedup", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: SQL can express neither the classifier nor near copies nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    What lies between two stages is written to the shared checkpoint folder and deleted once the next stage is written; the
    last folder stays, as the result reads it.
    """
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        written = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before is not None:
            remove_folder(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
