"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat import chat_trees
from .exact_dedup import exact_dedup
from .mixing import MIX_SQL, mix_sources
from .packing import pack
from .quality import quality
from .simhash import near_duplicates
from .token_counts import token_counts
from .topk import TOPK_SQL, top_k
from .toxicity import toxicity
from .warc import WARC_SQL, page_records


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_trees(_table(spark, sf_dir, "conversations"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(_table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_topk, op2_simhash, op3_mixing, op4_packing, op5_chat, op6_exact_dedup, op7_toxicity, op8_warc, op9_quality, op10_token_counts)
}

ORACLE_SQL = {
    "op1_topk": TOPK_SQL,
    "op8_warc": WARC_SQL,
    "op3_mixing": MIX_SQL,
    "op6_exact_dedup": """
        select doc_id, keep_id from (
          select doc_id, row_number() over (partition by text order by doc_id nulls last) as n, min(doc_id) over (partition by text) as keep_id
          from documents where text is not null)
        where n > 1""",
}
