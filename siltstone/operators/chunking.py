"""Overlapping chunks that end at sentence ends where there is one, and the tables derived from chunks."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNAP = 200  # a chunk may end so many characters early
_END = re.compile(r"[.!?。！？]\s+")
BATCH = 256  # documents that are Python strings at a time
ID_STEP = 1_000_000  # chunk_id = doc_id * ID_STEP + chunk_index


def spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of every window over a stripped text."""
    out, i, n = [], 0, len(text)
    while i < n:
        j = min(n, i + size)
        if j < n:
            s = max(i, j - SNAP)
            last = None
            for last in _END.finditer(text, s, j):
                pass
            if last:
                j = last.end()
        out.append((i, j))
        if j >= n:
            break
        after = max(0, j - overlap)
        if after <= i:
            raise ValueError(f"chunks of {size} with an overlap of {overlap} don't advance")
        i = after
    return out


def chunk_udf(size: int, overlap: int):
    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        parts = []
        for lo in range(0, len(texts), BATCH):  # what Python holds of texts and chunks is bounded
            out = []
            for text in texts.slice(lo, BATCH).to_pylist():
                text = (text or "").strip()
                out.append([c for i, j in spans(text, size, overlap) if (c := text[i:j].strip())])
            parts.append(pa.array(out, pa.list_(pa.string())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return cut


def with_titles(documents: DataFrame) -> DataFrame:
    """The documents table in the role of docs: url and title derived, all active."""
    return documents.select(
        "doc_id", "source", F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"), "text",
    )


def chunk_documents(documents: DataFrame, size: int = 600, overlap: int = 150, keep: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """chunk_id, doc_id, chunk_index, text, text_len, chunk_hash; ``keep`` filters chunks, whose indexes stay as they were.
    ``carry`` names columns of the document that its chunks take along, which spares a join."""
    rows = documents.select("doc_id", *carry, F.posexplode(chunk_udf(size, overlap)("text")).alias("chunk_index", "text"))
    if keep is not None:
        rows = rows.where(keep)
    return rows.select(
        (F.col("doc_id") * ID_STEP + F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", "text",
        F.length("text").alias("text_len"), F.sha2("text", 256).alias("chunk_hash"), *carry,
    )


def parents(chunks: DataFrame, children: int = 12) -> DataFrame:
    """One row a parent: every ``children`` neighbouring chunk indexes of a document."""
    at = F.floor(F.col("chunk_index") / children).cast("int")
    return (
        chunks.groupBy("doc_id", at.alias("parent_index"))
        .agg(F.min("chunk_index").alias("start_chunk_index"), F.max("chunk_index").alias("end_chunk_index"))
        .withColumn("parent_id", F.col("doc_id") * ID_STEP + F.col("parent_index"))
    )


def parent_map(chunks: DataFrame, children: int = 12) -> DataFrame:
    """chunk_id to parent_id; a projection, since the parent follows from the index."""
    return chunks.select("chunk_id", (F.col("doc_id") * ID_STEP + F.floor(F.col("chunk_index") / children)).alias("parent_id"))


def sync(index: DataFrame, dirty: DataFrame, rebuilt: DataFrame, key: str = "doc_id") -> DataFrame:
    """An index with the rows of dirty documents replaced by rebuilt ones."""
    ids = dirty.select(key).distinct()
    return index.join(ids, key, "left_anti").unionByName(rebuilt.join(ids, key, "left_semi"))
