"""Documents that arrive: what changed, upserts, chunk reconciliation, dirty marks. No operation updates in place; each returns the new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def detect_changes(incoming: DataFrame, docs: DataFrame, chunks: DataFrame, embeddings: DataFrame, forced: Column | None = None) -> DataFrame:
    """url and status of every incoming document (url, raw_hash): NEW, FORCED, CHANGED, REBUILD_NO_CHUNKS, EMBED_ONLY or UNCHANGED."""
    state = (
        chunks.where("is_active")
        .join(embeddings.select("chunk_id", F.lit(1).alias("has")), "chunk_id", "left")
        .groupBy("doc_id")
        .agg(F.count("*").alias("n"), F.sum(F.when(F.col("has").isNull(), 1).otherwise(0)).alias("missing"))
    )
    known = docs.select("url", "doc_id", F.col("raw_hash").alias("old_hash")).join(state, "doc_id", "left")
    n, missing = F.coalesce("n", F.lit(0)), F.coalesce("missing", F.lit(0))
    status = (
        F.when(F.col("doc_id").isNull(), "NEW").when(forced if forced is not None else F.lit(False), "FORCED").when(F.col("raw_hash") != F.col("old_hash"), "CHANGED")
        .when(n == 0, "REBUILD_NO_CHUNKS").when(missing > 0, "EMBED_ONLY").otherwise("UNCHANGED")
    )
    return incoming.join(known, "url", "left").select("url", "doc_id", status.alias("status"))


def moved(docs: DataFrame) -> DataFrame:
    """Documents whose text a later document of the same source has under another url: doc_id, moved_to."""
    w = Window.partitionBy("source", "raw_hash")
    return docs.withColumn("moved_to", F.max("doc_id").over(w)).where("doc_id < moved_to").select("doc_id", "moved_to")


def reject_exact_duplicates(docs: DataFrame) -> DataFrame:
    """Keeps the first document of each source and normalised hash."""
    return latest(docs, ["source", "norm_hash"], [F.col("doc_id")])


def upsert_docs(docs: DataFrame, incoming: DataFrame) -> DataFrame:
    """docs with incoming rows merged by url: an existing row keeps its doc_id and source and takes the rest, status becomes 1.
    Of incoming rows with one url that with the largest doc_id counts."""
    incoming = latest(incoming, ["url"], [F.desc("doc_id")])
    a, b = docs.alias("a"), incoming.alias("b")
    pick = lambda c: F.when(F.col("b.url").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return a.join(b, F.col("a.url") == F.col("b.url"), "full_outer").select(
        F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), F.coalesce("a.source", "b.source").alias("source"), F.coalesce("a.url", "b.url").alias("url"),
        pick("title"), pick("raw_hash"), F.when(F.col("b.url").isNotNull(), F.lit(1)).otherwise(F.col("a.status")).alias("status"),
    )


def reconcile_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of rebuilt documents: those that the new text still has at their index are active with the new hash, the rest are not."""
    o, n = old.alias("o"), new.alias("n")
    on = (F.col("o.doc_id") == F.col("n.doc_id")) & (F.col("o.chunk_index") == F.col("n.chunk_index"))
    return o.join(n, on, "full_outer").select(
        F.coalesce("o.doc_id", "n.doc_id").alias("doc_id"), F.coalesce("o.chunk_index", "n.chunk_index").alias("chunk_index"),
        F.coalesce("n.chunk_hash", "o.chunk_hash").alias("chunk_hash"), F.col("n.doc_id").isNotNull().alias("is_active"),
    )


def drop_stale_embeddings(embeddings: DataFrame, chunks: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """embeddings without those of the rebuilt documents' chunks."""
    return embeddings.join(chunks.join(rebuilt.select("doc_id").distinct(), "doc_id", "left_semi"), "chunk_id", "left_anti")


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    return chunks.where("is_active").join(embeddings, "chunk_id", "left_anti")


def dirty_marks(feed: DataFrame) -> DataFrame:
    """The last mark of each document; equal times: the larger reason."""
    return feed.groupBy("doc_id").agg(F.max_by("reason", F.struct("marked_at", "reason")).alias("reason"), F.max("marked_at").alias("marked_at"))


def upsert_vectors(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """stored with imported vectors, which win; imported rows without a vector are left out."""
    both = stored.withColumn("__p", F.lit(1)).unionByName(imported.where("embedding is not null").withColumn("__p", F.lit(0)))
    return latest(both, ["chunk_id"], [F.col("__p")]).drop("__p")
