"""The corpus pipeline: five stages over `documents`, each reading all that its predecessor kept.

toxicity drops rejected documents; jaccard keeps the document with the smallest id of each near-duplicate
component; suffix_array cuts repeated byte strings out of the texts; decontamination drops documents that
hold benchmark items; packing gives one row for each packed piece.  All but the last return the columns of
documents.

Defined results: nulls in any column pass through; null and empty texts are never toxic, duplicate or
contaminated and pack to one token; empty tables give empty results; columns beyond those of documents are
kept by all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, jaccard_join, packing, suffix_dedup, toxicity
from weftline.llm.runtime import shared_folder


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


def _jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def _suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("jaccard_join", _jaccard),
    ("suffix_array", _suffix_array),
    ("decontamination", _decontamination),
    ("packing", _packing),
]

#: Trained scores and tokenization are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
