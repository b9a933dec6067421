"""A training corpus from ``documents``: toxic texts and texts in no known language go, one of
each group of near copies stays, the sources are mixed to their weights, and the texts encoded.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it.
Models are learnt from the given tables (``labels``, and the documents of ``sf_dir``).
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from credsift.llm import bpe, language, mixing, simhash, toxicity  # noqa: E402
from credsift.llm.common import prepared, table  # noqa: E402
from credsift.session import cut  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no identified language go."""
    return language.kept_documents(docs, language.train(language.known_texts(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the least doc_id."""
    return simhash.dedup(docs, shingle=simhash.SHINGLE, distance=simhash.DISTANCE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as their source's target asks for."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text."""
    return bpe.encode(docs.select("doc_id", "source", "lang", "text")).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

# learnt models and hashed fingerprints have no SQL twin; tests hold the stages to brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
