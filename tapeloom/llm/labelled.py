"""Labelled documents for the classifiers: a bounded sample, held-out rows never among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import pick, sample_by_hash, written

#: Labelled documents to learn from: all up to this many, else about so many by hash of their id.
FIT_DOCS = 20_000


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the doc_id as text, modulo ``by``; null ids as text ``null``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))), F.lit(by))


def examples(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(text, label) of labelled documents that ``learn_from`` (over doc_id) admits, written once.

    The labels are cut to the bound before the join, so their side is broadcast with a proven size
    and the documents are not shuffled. Rows without an id or a label are left out.
    """
    known = pick(labels, doc_id="doc_id", label=label).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).where(learn_from).distinct()
    known = sample_by_hash(known, "doc_id", fit_docs, known.count())
    own = known.select(F.col("doc_id").alias("own"), (F.col("label") > 0).cast("int").alias("label"))
    docs = pick(docs, "doc_id", "text")
    return written(docs.join(F.broadcast(own), docs["doc_id"] == own["own"]).select(F.coalesce("text", F.lit("")).alias("text"), "label"), "examples")
