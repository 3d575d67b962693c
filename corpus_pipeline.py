"""The corpus pipeline: five stages over documents, each on all rows that the one before kept.

toxicity         documents that score 0.5 or more go
exact dedup      of texts that are equal after lower-casing A-Z, the smallest doc_id stays
near dedup       of each class of near-duplicates (five words, weighted Jaccard of 0.8 or more), the smallest doc_id stays
secrets          every document stays; secrets in its text are masked and n_chars is counted anew
packing          pieces of the documents' ids in sequences of at most 4096 tokens

All stages but the last return the columns of documents. Models and counts are learned from the stage's own input. Null and
empty texts are texts without words: equal to each other, so one of them stays; blank ones join them at near dedup. A null doc_id
counts as the smallest one and is null again in the result. Texts of any length are read whole by every stage. Ties go to the smallest doc_id, and of
rows that repeat doc_id and text one stays; of one doc_id with different texts, near dedup keeps one row, of the smallest text. Nulls in other
columns are carried along, as are further columns, whatever their names, up to packing, which returns its own. An empty table gives no
pieces; without labels no document is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import common, exact, neardup, packing, secrets, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.train(docs, common.read(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.dedup(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Learned scores, consistent sampling and tokenization have no SQL; tests/llm compares the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir's documents. Between stages the documents are written as Parquet and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.saved(docs, f"stage-{name}")
    return docs
