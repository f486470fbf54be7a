"""The corpus pipeline: documents in, a cleaned and weighted mix out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk.llm.catalog import held_out
from statewalk.llm.common import fresh
from statewalk.llm.decontam import without_contaminated
from statewalk.llm.mixing import mixed_documents
from statewalk.llm.quality import classify_quality, fit_quality
from statewalk.llm.secrets import redact_secrets
from statewalk.llm.simhash import first_of_groups
from statewalk.sources.store import cut
from statewalk.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    forest = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    score, predicted = fresh(docs, "score"), fresh(docs, "predicted")
    scored = classify_quality(docs, forest, score=score, predicted=predicted)
    return scored.where(F.col(predicted) == 1).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return first_of_groups(docs, shingle=3, max_bits=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat ten successive words of a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    redacted = redact_secrets(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often and how many words."""
    return mixed_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("mixing to target weights", mixing_stage),
]

#: A trained classifier and fingerprints have no SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
