"""From raw documents to token ids: quality, line dedup, near duplicates, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeflow.llm.bpe import encoded
from citeflow.llm.jaccard_join import keep_one
from citeflow.llm.line_dedup import deduplicated
from citeflow.llm.mixing import mixed_rows
from citeflow.llm.quality import keep_good
from citeflow.llm.tables import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules' posterior keeps."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each class of similar lines in one place of the corpus only."""
    return deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the decoded text of every row."""
    return encoded(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", encoding),
]

# Expectation-maximisation, MinHash and byte-pair merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), str(i))
        if i:
            scratch.drop(str(i - 1))
    return docs
