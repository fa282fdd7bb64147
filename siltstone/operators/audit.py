"""Views over the stored tables, and audits, which return the rows that are wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(c: str = "status") -> Column:
    return F.coalesce(F.col(c), F.lit(1)) == 1


def source_summary(docs: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per source: documents, active chunks, embedded chunks, missing embeddings, documents without active chunks."""
    has = embeddings.select("chunk_id", F.lit(1).alias("has"))
    per = chunks.where("is_active").join(has, "chunk_id", "left").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count("has").alias("embedded"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return docs.join(per, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("docs"), n("chunks").alias("active_chunks"), n("embedded").alias("embedded_chunks"),
        n(F.col("chunks") - F.col("embedded")).alias("missing_embeddings"), F.sum(F.col("chunks").isNull().cast("long")).alias("docs_without_chunks"),
    )


def hash_failures(rows: DataFrame, key: str, text: str, digest: str, kind: str) -> DataFrame:
    """kind, id, reason of rows without text or hash, or whose hash isn't the text's."""
    reason = F.when(F.col(text).isNull(), "missing_text").when(F.col(digest).isNull(), "missing_hash").when(F.sha2(text, 256) != F.col(digest), "hash_mismatch")
    return rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), reason.alias("reason")).where("reason is not null")


def orphans(docs: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    no_doc = chunks.join(docs, "doc_id", "left_anti").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"))
    no_chunk = embeddings.join(chunks, "chunk_id", "left_anti").select(F.lit("embedding"), "chunk_id")
    return no_doc.unionAll(no_chunk)


def docs_without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return docs.where(active()).join(chunks.where("is_active"), "doc_id", "left_anti")


def failure_summary(failures: DataFrame) -> DataFrame:
    return failures.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def index_difference(index: DataFrame, table: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys that only one of the two has, with the side that lacks them."""
    a, b = index.select(key).distinct(), table.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("lacks", F.lit("index")).unionAll(a.join(b, key, "left_anti").withColumn("lacks", F.lit("table")))


def assert_none(failures: DataFrame, what: str) -> None:
    """Raises if an audit found anything; counts only up to the first few."""
    some = failures.limit(3).collect()
    if some:
        raise ValueError(f"{what}: {[r.asDict() for r in some]}")


def lcg_order(key: str, seed: int) -> Column:
    """(key * 1103515245 + seed) % 2147483647 of keys of any size, computed in decimals where 64 bits don't hold the product."""
    lcg = lambda c: (c * F.lit(1103515245) + F.lit(seed)) % F.lit(2147483647)
    return F.when(F.col(key).between(-8_000_000_000, 8_000_000_000), lcg(F.col(key).cast("long"))).otherwise(lcg(F.col(key).cast("decimal(19,0)")).cast("long"))


def sample_by_lcg(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows in an order that looks random and is the same everywhere."""
    return rows.orderBy(lcg_order(key, seed), key).limit(n)
