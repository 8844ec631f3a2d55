"""Corpus pipeline: quality, exact dedup, near dedup, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes every stage's result in the
shared folder and reads it again as the next stage's documents, so that a lost executor repeats one stage
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookengine.llm.exact_dedup import drop_repeats
from bookengine.llm.mixing import mixed_documents
from bookengine.llm.ngram_join import one_of_each_component
from bookengine.llm.packing import pack_documents
from bookengine.llm.quality import keep_quality
from bookengine.llm.queries import tokenizer_path
from bookengine.llm.store import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score from 0.5 on)."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one of largest id."""
    return drop_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id."""
    return one_of_each_component(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 3 times)."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources", mix),
    ("packing", pack),
]

#: The classifier and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
