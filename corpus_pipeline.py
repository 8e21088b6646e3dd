"""Corpus pipeline: quality rules, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sextant.llm import minhash, packing, pii, quality, toxicity
from sextant.llm.common import kept_paths, stored, sweep, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed limits and the robust outlier test keep."""
    return quality.filter_quality(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not call toxic; it learns from the labels of those given."""
    return toxicity.drop_toxic(docs, toxicity.fitted(spark, docs, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return minhash.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and n_chars counted anew."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", best_fit_packing),
]

#: Trained models, signatures and tokenisation are not SQL; a test holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; each stage's result is stored and what it was made from is deleted.

    Nulls: a document with a null text fails the quality rules; null languages and sources are groups of their own, and rows
    without an id pass near-duplicates. Repeated rows are copies of each other, one id each, so the smallest id stays, with all
    rows of that id. Empty tables give no rows; texts of any length are read whole; extra columns pass through the stages
    untouched, whatever their names.
    """
    docs, before = table(spark, sf_dir, "documents"), kept_paths(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, kept_paths(spark) - before - {docs.stored_at})
    return STAGES[-1][1](spark, docs, sf_dir)
