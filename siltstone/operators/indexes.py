"""Indexes as tables: postings, vectors, quantised vectors, sparse vectors, inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .terms import Md5, Terms, chunk_slices, count_keys, slices


def index_terms(c: Column) -> Column:
    """Lower-cased runs of letters and digits without Latin accents, in order."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, field, tf, positions from chunk_id, title, text.

    A posting only depends on its chunk, so postings are made where the chunk is, without a shuffle, for many chunks at once.
    """
    schema = pa.schema([("term", pa.string()), ("chunk_id", pa.int64()), ("field", pa.string()), ("tf", pa.int32()), ("positions", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fields = b.column(0).to_numpy(), {"title": b.column(1).to_pylist(), "text": b.column(2).to_pylist()}
            for name, texts in fields.items():
                for lo, hi in slices([texts]):
                    t = Terms(texts[lo:hi])
                    if not len(t.rows):
                        continue
                    before = np.cumsum(t.lengths()) - t.lengths()
                    place = (np.arange(len(t.rows)) - before[t.rows]).astype(np.int32)
                    order = np.lexsort((place, t.hashes, t.rows))
                    rows, h = t.rows[order], t.hashes[order]
                    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])]))
                    _, one, back = np.unique(h[first], return_index=True, return_inverse=True)
                    words = pa.array([t.text(k) for k in order[first[one]]], pa.string())
                    offsets = np.append(first, len(rows)).astype(np.int32)
                    columns = [
                        words.take(pa.array(back)), pa.array(ids[lo:hi][rows[first]]), pa.repeat(pa.scalar(name), len(first)), pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[order])),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return chunks.select("chunk_id", "title", "text").mapInArrow(run, "term string, chunk_id long, field string, tf int, positions array<int>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    """The norm is bound once, as the element of an array, and not computed again for every dimension."""
    by = lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), by), 0)


def flat_index(embeddings: DataFrame, metric: str = "ip") -> DataFrame:
    """chunk_id, embedding (doubles; of length 1 for inner product)."""
    if metric not in ("ip", "l2"):
        raise ValueError(f"no metric {metric!r}")
    v = l2_normalised(F.col("embedding")) if metric == "ip" else F.transform("embedding", lambda x: x.cast("double"))
    return embeddings.select("chunk_id", v.alias("embedding"))


def calibration(index: DataFrame) -> DataFrame:
    """dim, lo, hi over all vectors."""
    return index.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def quantise(index: DataFrame, bits: int = 4) -> DataFrame:
    """chunk_id, codes: each dimension on a scale of 2**bits steps between its extremes. The scale is one row, broadcast."""
    if bits not in (2, 4, 8):
        raise ValueError("bits must be 2, 4 or 8")
    scale = calibration(index).agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))).alias("scale"))
    top = (1 << bits) - 1
    code = lambda x, s: F.when(s["hi"] > s["lo"], F.floor((x - s["lo"]) / (s["hi"] - s["lo"]) * top + 0.5)).otherwise(F.lit(0)).cast("int")
    return index.crossJoin(F.broadcast(scale)).select("chunk_id", F.zip_with("embedding", "scale", code).alias("codes"), "scale")


def dequantise(quantised: DataFrame, bits: int = 4) -> DataFrame:
    top = (1 << bits) - 1
    return quantised.select("chunk_id", F.zip_with("codes", "scale", lambda c, s: s["lo"] + c * (s["hi"] - s["lo"]) / top).alias("embedding"))


def sparse_rows(batches: Iterator[pa.RecordBatch], buckets: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of chunks: their ids, and rows (in order), term ids and weights of their encodings."""
    digest = Md5()

    def bucket(t: Terms) -> np.ndarray:
        return digest(t) % buckets

    for ids, titles, of, texts in chunk_slices(batches):
        rows, term, n = count_keys(Terms(titles), Terms(texts), of, bucket, buckets)
        many = np.flatnonzero((np.bincount(rows, minlength=len(ids)) > most)[rows])  # only these chunks lose any
        order = many[np.lexsort((term[many], -n[many], rows[many]))]
        lost = order[np.arange(len(order)) - np.searchsorted(rows[order], rows[order]) >= most]
        keep = np.ones(len(rows), bool)
        keep[lost] = False
        yield ids, rows[keep], term[keep], np.log1p(n[keep])


def sparse_index(chunks: DataFrame, buckets: int = 4096, most: int = 256) -> DataFrame:
    """term_id, chunk_id, weight: term counts dampened by a logarithm, hashed, the heaviest ``most`` a chunk. Stands in for a learned encoder.

    Chunks are encoded where they are, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, term, weight in sparse_rows(batches, buckets, most):
            yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(ids[rows]), pa.array(weight)], names=["term_id", "chunk_id", "weight"])

    return chunks.select("chunk_id", "title", "text").mapInArrow(run, "term_id int, chunk_id long, weight double")


def ivf_index(index: DataFrame, lists: int, seed: int = 1) -> tuple[DataFrame, list[tuple[int, list[float]]]]:
    """The index with a list_id, and the lists' centroids (k-means)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = index.withColumn("features", array_to_vector("embedding"))
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(rows)
    centers = [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]
    return model.transform(rows).select("chunk_id", "embedding", F.col("prediction").alias("list_id")), centers


def check_manifest(stored: dict, wanted: dict, policy: str = "error") -> list[str]:
    """What differs; raises, warns or says nothing about it by policy."""
    if policy not in ("error", "warn", "ignore"):
        raise ValueError(f"no policy {policy!r}")
    if policy == "ignore":
        return []
    wrong = [f"{k}: {stored.get(k)!r} instead of {v!r}" for k, v in sorted(wanted.items()) if stored.get(k) != v]
    if wrong and policy == "error":
        raise ValueError("; ".join(wrong))
    return wrong


def after_watermark(chunks: DataFrame, watermark: int, dirty: DataFrame) -> DataFrame:
    """Chunks that an index with a watermark lacks: later ones, and those of dirty documents before it, marked reactivated."""
    again = chunks.where(F.col("chunk_id") <= watermark).join(dirty.select("doc_id").distinct(), "doc_id", "left_semi")
    return chunks.where(F.col("chunk_id") > watermark).withColumn("shard", F.lit("new")).unionByName(again.withColumn("shard", F.lit("reactivated")))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
