"""Corpus preparation as a chain of stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps; its result is written as
Parquet and reread as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import bestfit, bigru, jaccard, quality, substrings
from meridia.llm.workspace import Workspace

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts; it learns from the labels of those here."""
    return quality.good_documents(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network recognises."""
    return bigru.known_language(spark, docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles with a similarity of 0.8 or more link, the smallest id."""
    return jaccard.one_per_group(spark, docs, jaccard.Threshold(80, 100, 5))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 20-word windows that start earlier as well, the kept words joined by one
    space; texts without such windows stay as they are, and documents that lose every word go."""
    return substrings.cut_texts(spark, docs, 20)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return bestfit.packed(spark, docs, WORD_BPE, 2048, 0)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]

#: Not to be said in SQL: trained models, tokens and a search for bins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's table is written before the next reads it."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = space.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            space.drop(f"stage{k - 1}")
    return docs.select(*[F.col(c) for c in docs.columns])
