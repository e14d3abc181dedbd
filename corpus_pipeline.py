"""Corpus pipeline over ``documents``: quality rules, quality classifier, near-duplicates, packing.

Every stage works on all rows that its predecessor kept and, but for the last, returns the columns of
``documents``. Rules and classifier drop the documents they reject, the near-duplicate stage keeps one
document of each group (five-word shingles, similarity of 0.8 or more), packing places the tokens of what
is left. Nulls, empty texts, repeated rows and further columns are treated as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motionframe.llm import best_fit_packing, minhash, quality_classifier, quality_rules
from motionframe.llm._common import table, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule about length or repetition rejects; style is the next stage's business."""
    return quality_rules.filter_documents(docs, quality_rules.STRUCTURE)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the cut of a model fitted on all labelled documents, those that the rules dropped included.

    Without labels of both kinds every score is 0.5 and nothing is dropped.
    """
    return quality_classifier.filter_documents(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.deduplicated(docs, shingle=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences of 2048 ids."""
    return best_fit_packing.packed_documents(docs)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_duplicates", near_duplicates), ("best_fit_packing", packing)]

#: A learned model, minhash groups and tokenizing can't be put in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's result is stored and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
