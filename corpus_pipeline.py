"""Corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and gives rows with the columns
of docs, the last one pieces. Defined results, of each stage as of its operator: a null text counts as empty, is not
toxic, is an exact copy of other empty texts, links with no text, and packs as one end token; rows without an id stay
through every stage as far as their text does; of repeated rows one is left after exact dedup; long texts are read
whole; other columns pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import exact_dedup, mixing, near_dedup, packing, queries, toxicity
from maskwright.scratch import discard, materialize

#: Shares of tokens by labelled quality. No document is thinned out: the total grows until all shares fit.
TARGETS = {"low": 0.10, "high": 0.90}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on the labels does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each text."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets alike to 0.8 or more."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as their fitted rates say, at least once."""
    labelled = queries.quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.apply_rates(docs, labelled, TARGETS, least=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
