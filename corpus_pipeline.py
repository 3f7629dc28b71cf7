"""From raw documents to packed training sequences, stage by stage.

Each stage gets what its predecessor kept, written as Parquet and read again.

In every stage null text counts as empty; empty texts are rows like others
(they are one group of exact copies, near nothing, free of benchmark passages
and packed as their end id alone). Texts of any length are read whole. Ties
go to the greater doc_id among exact copies and to the smaller one among near
copies. Repeated rows, rows that share a doc_id and rows without one are told
apart by their text. Stages but the last return the columns they were given, whatever
else these are called; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedlake.llm.common import materialize
from feedlake.llm.decontaminate import drop_contaminated
from feedlake.llm.exact_dedup import drop_exact_duplicates
from feedlake.llm.importance import keep_sampled
from feedlake.llm.jaccard_join import drop_near_duplicates
from feedlake.llm.packing import pack
from feedlake.llm.queries import table, word_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by importance weight; rejected ones go."""
    return keep_sampled(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at similarity 0.8 or more, the one with the smallest doc_id."""
    return drop_near_duplicates(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens, one row per piece."""
    return pack(docs, word_bpe(), capacity=2048, end_id=0)


STAGES = [
    ("quality", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Sampling, Jaccard components and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
