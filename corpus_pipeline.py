"""From raw documents to token ids in five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents. ``run`` writes each stage's result to
the shared folder, so a lost executor costs no more than a part of one stage.

Defined results: a null or empty text has no words, so the quality rules reject it; a null doc_id
comes after all others where one of several copies stays and before them where a line stays with
the largest; a null source is a source of its own, a null lang is passed through, n_chars is the
length of the text once the line stage has run; texts of any length are processed whole; rows
repeated whole count once from the near-copy stage on; an empty table gives an empty result;
columns other than those of documents are left behind.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import line_runs, mixing, near_texts, quality_rules, spm_bpe
from tapeloom.llm.common import pick, written

#: The columns that stages hand on; others are left behind.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
RANKS = "byte_bpe_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.filtered(pick(docs, *COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay only in the largest doc_id; n_chars follows the text."""
    return line_runs.without_frequent_lines(pick(docs, *COLUMNS), batches=4)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a Jaccard similarity of 0.8 or more over five-word shingles the smallest doc_id stays.

    SimHash fingerprints and their vantage-point tree find the closest pairs; ``near_texts`` says
    how the others are found, and compares all of them exactly.
    """
    return near_texts.first_of_each(pick(docs, *COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target words: documents go, stay, or are repeated."""
    return mixing.mixed_documents(pick(docs, *COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of what they decode to."""
    return spm_bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

#: Fingerprints and the rule order have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
