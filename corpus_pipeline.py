"""The corpus pipeline: each stage reads what its predecessor kept, written as Parquet in between.

Stages take (spark, docs, sf_dir).  All but the last return the columns of ``documents``: quality rules drop
rejected documents and lines above the limits, near-dedup keeps one document of each component,
decontamination drops documents in which a benchmark window occurs, mixing repeats or drops documents to meet
the targets of their sources, and the last stage returns packed token rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlens.llm.common import read, staged
from meterlens.llm.decontamination import decontaminated
from meterlens.llm.minhash import deduplicated
from meterlens.llm.mixing import mixed_documents
from meterlens.llm.packing import packed
from meterlens.llm.quality_rules import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(spark, docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("packing", packing),
]

#: Token ids, components and packing have no statement in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
