"""A corpus cleaning pipeline: each stage's result is written as Parquet and read again by the next.

Every stage takes documents with nulls in any column, empty and very long texts, ties, repeated rows, and more columns of any name, and an
empty table, which stays empty. What becomes of each is said in the stages and, in full, in the operators they call.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import bpe, jaccard, mixing, pii, quality
from cohortlake.llm.work import Scratch, read


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores as good; null and empty texts are scored by statistics of zero, repeated rows share their fate."""
    return quality.good_documents(docs, read(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the least id, nulls last; texts without words are alone and stay, a repeated row stays once."""
    return jaccard.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows, personal data replaced by its kind; null texts stay null, n_chars is counted anew."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; a null source is a source, a text without words costs nothing, repeated rows are taken alike."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of every row; null and empty texts have no tokens, a repeated row is encoded each time."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: A learned classifier and byte-pair merging have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs, last = scratch.save(stage(spark, docs, sf_dir)), before
        before = docs
        if last is not None:
            scratch.free(last)
    return STAGES[-1][1](spark, docs, sf_dir)
