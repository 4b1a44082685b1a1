"""A corpus pipeline of five stages; each stage's rows are written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import common, decontaminate, packing, quality, simhash, substrings
from corpusloom.llm.registry import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It is fitted on the labelled rows of the table that it is given.

    Null, empty and blank texts score by the model's offset; repeated rows and rows without an id are scored each; without
    labels every document scores one half and is rejected; an empty table stays empty; other columns are kept.
    """
    return quality.accepted(docs, common.table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard similarity 0.8 or more): the one with
    the smallest doc_id. The query op9_simhash has a rule of its own.

    Null, empty and blank texts are copies of each other; repeated rows, and texts that share a doc_id, leave one; rows
    without a doc_id stay; a similarity of exactly 0.8 links; an empty table stays empty; other columns are kept.
    """
    return simhash.drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; n_chars follows.

    No document goes: a text may become empty, a null one stays null. Repeated rows are copies, so they lose what they
    share. Very long texts are held whole in their task; an empty table stays empty; other columns are kept.
    """
    return substrings.remove(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows; n_chars follows.

    No document goes; null texts stay null; null items and item ids are none; repeated rows are cut each; very long texts
    are cut into overlapping stretches; an empty table or benchmark changes nothing; other columns are kept.
    """
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in packed sequences. Null and empty texts are one id; repeated rows, and rows without a doc_id,
    are packed each; an empty table gives no pieces."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pack", pack),
]

#: Stages fit a model, follow links and tokenise: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last stage's rows."""
    docs = common.table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = common.stage(docs, f"pipeline-{name}")
    return docs
