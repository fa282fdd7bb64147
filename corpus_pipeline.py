"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Null, empty and very long texts, ties, repeated rows and columns of any name are treated as the operators' docstrings say: all stages but the last
return rows of their input as they are, texts without words pass the filters (equal ones are exact copies of each other), and empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.exact_dedup import drop_exact
from siltstone.llm.mixing import MixParams, keep_mixture
from siltstone.llm.packing import pack
from siltstone.llm.shared import shared_dir
from siltstone.llm.simhash import drop_near
from siltstone.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model, trained on the labelled ones, rejects."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of those with equal texts."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps nine tenths of the blocks; those that go are of the sources that are furthest above their weights."""
    return keep_mixture(docs, MixParams(share=0.9))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; one row a piece."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mix), ("packing", packed)]

#: A trained model and SimHash are beyond SQL; tests hold each stage against a naive version of it in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``; what is between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{at}-{name}")
            docs = spark.read.parquet(f"{base}/{at}-{name}")
            if before:
                _remove(spark, before)
            before = f"{base}/{at}-{name}"
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
