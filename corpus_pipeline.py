"""The corpus pipeline: documents that pass each stage go to the next one.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result into the shared folder and reads it
again before the next stage. All stages but the last return the columns of documents.

In every stage a null text counts as empty, rows without doc_id are left out, rows alike are judged alike (near-duplicate removal
keeps one of a group, all rows of its smallest id), a text of any length is read whole, an empty table gives an empty table, and
columns besides doc_id and text pass through whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.llm import bpe, decontam, neardup, quality, secrets
from shiftlens.llm.common import free_name, table, written

#: Quality score from which a document is kept, and words and similarity of near copies.
CUT, WORDS, PERCENT = 0.7, 5, 80
#: Characters of the encoder's chunks and words of its dictionary: few, as executors come to it with a heap that earlier stages grew.
CHUNK, DICTIONARY = 4 << 20, 60_000
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "__score")
    return quality.add_scores(docs, model, score).where(F.col(score) >= CUT).drop(score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    return neardup.deduplicate(docs, WORDS, PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secrets.redact_secrets(docs, secrets.fit(docs))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return bpe.encode_documents(docs, bpe.read_ranks(RANKS), public_tokenizers.PATTERN, chunk=CHUNK, dictionary=DICTIONARY)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secrets_stage),
    ("byte-level encoding", tokens_stage),
]

#: Classifier, MinHash and merges can't be said in SQL; tests hold each stage's operator against brute force or its library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k + 1}")
    return docs
