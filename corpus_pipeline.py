"""A corpus in five stages: toxic documents go, one document of each near-duplicate group stays, personal data becomes
pseudonyms, sources are mixed to equal weights, and token sequences are packed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import free_names, read_table, release, shared_dir
from tessera.llm.mixing import mixed
from tessera.llm.packing import pack
from tessera.llm.pii import configured_key, pseudonymised
from tessera.llm.similar import one_of_each
from tessera.llm.toxicity import accepted


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the labels of the input's own folder; what it rejects goes."""
    return accepted(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 0.8 or more of their five-word shingles; SimHash balls find them."""
    return one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (replaced,) = free_names(docs, "pii_replaced")
    return pseudonymised(docs, configured_key(spark), replaced=replaced).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copy, order = free_names(docs, "mix_copy", "mix_order")
    return mixed(docs, copy=copy, order=order).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("mixing", mixing),
    ("packing", packing),
]

#: Neither the classifier nor the tokenizer can be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written as Parquet and read again as the next one's documents."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/tessera/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        # What the stage wrote on its way isn't needed any more.
        release(spark)
        docs = spark.read.parquet(path)
    return docs
