"""The corpus pipeline: quality rules, line dedup, near copies, repeated substrings, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the next
stage's documents, with the columns of ``documents``; the last returns the packed pieces.  ``run``
writes every stage's result to the cluster's shared folder and reads it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm import jaccard_join, line_dedup, packing, quality_rules, suffix_dedup
from kvloom.llm.queries import tokenizer_path
from kvloom.llm.shipping import materialise


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they now are."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.keep_good(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those left without a line go."""
    return _counted(line_dedup.remove_lines(docs, drop_emptied=True))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return jaccard_join.keep_one(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated strings."""
    return _counted(suffix_dedup.remove_repeats(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", repeated_lines),
    ("jaccard_join", near_copies),
    ("suffix_array_dedup", repeated_substrings),
    ("best_fit_packing", packed),
]

#: Winnowed anchors, shingle hashes and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
