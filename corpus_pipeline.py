"""A training corpus from documents: quality, near duplicates, benchmark leaks, secrets, and a mixture of sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, the last
adds to them how often and where in the mixture each one occurs. In every stage null texts are like empty ones, null ids
are ids like any other, columns may have any name besides those of documents, and an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crestline.llm.common import discard, materialise, read, scratch_scope
from crestline.llm.decontam import drop_contaminated
from crestline.llm.mixing import mix_sources
from crestline.llm.neardup import drop_near_duplicates
from crestline.llm.quality import reject_low_quality
from crestline.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; repeated rows go or stay together."""
    return reject_low_quality(docs, read(spark, sf_dir, "labels"), docs_for_fit=read(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, Jaccard similarity 0.8.

    Candidates are the SimHash operator's components (op4's) and, beside them, texts that share a MinHash band; each link
    is verified. What stays is the one with the smallest id; of rows that repeat an id and a text one stays, the same on
    every run.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's shingles go; null and empty texts and items match nothing."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, repeated rows too; every secret in them is replaced by its kind in brackets."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time a document occurs in the mixture: all its columns, the text as it was cleaned among them, then
    n_tokens, weight, epoch and order_key. Repeated ids share a place; sources without words are in no mixture."""
    return mix_sources(docs, carry=True).rows


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
]

#: DuckDB can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again, and what it needed on the way is deleted."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch_scope() as made:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.keep(docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
