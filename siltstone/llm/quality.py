"""Quality: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are tokens (words as they are written, runs of punctuation) and pairs of neighbours; a token
that repeats the one before also counts as one shared feature. A text's vector holds each feature's
share of its features, times a constant; its score is the sparse dot product with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import mix, slices, tidy, tokens
from .toxicity import labelled, sample


@dataclass(frozen=True)
class QualityParams:
    """sample_rows bounds the labelled rows that are used for fitting: so many of each class at most.
    keep is the least probability of good quality with which a text is kept."""

    sample_rows: int = 5000
    bits: int = 20
    scale: float = 24.0
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    epochs: int = 4
    batch: int = 32
    keep: float = 0.5
    seed: int = 3


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashed features of a slice, in no order."""
    rows, h = tokens(buf, offsets)
    down = np.uint64(64 - bits)
    if len(h) < 2:
        return rows, (h >> down).astype(np.int64)
    pair = rows[1:] == rows[:-1]
    first, second = h[:-1][pair], h[1:][pair]
    both = mix(first * np.uint64(3) + second)
    same = first == second
    both[same] = np.uint64(0x243F6A8885A308D3)
    return np.concatenate([rows, rows[1:][pair]]), (np.concatenate([h, both]) >> down).astype(np.int64)


def _vectors(column: pa.Array, p: QualityParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, counts = [], []
    for first, buf, offsets in slices(column):
        rows, f = features(buf, offsets, p.bits)
        k, c = np.unique(((rows + first) << p.bits) | f, return_counts=True)
        keys.append(k)
        counts.append(c)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, count = np.concatenate(keys), np.concatenate(counts).astype(np.float64)
    rows = key >> p.bits
    return rows, key & ((1 << p.bits) - 1), p.scale * count / np.bincount(rows, weights=count, minlength=len(column))[rows]


def fit(texts: list[str], labels: np.ndarray, p: QualityParams = QualityParams(), stands_for: tuple[float, float] = (1, 1)) -> tuple[np.ndarray, float]:
    """Weights and bias. stands_for: how many labelled rows of class 0 and 1 one row of the sample stands for."""
    size = 1 << p.bits
    y = np.asarray(labels, np.float64)
    if len(np.unique(y)) < 2:  # nothing to tell apart: everything is kept
        return np.zeros(size, np.float32), 1.0
    rows, feature, value = _vectors(pa.array(texts, pa.large_string()), p)
    bounds = np.searchsorted(rows, np.arange(len(y) + 1))
    weight = np.where(y == 1, stands_for[1], stands_for[0])
    weight = weight / weight.mean()
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)  # the last one is the bias
    rng = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), p.batch):
            pick = order[lo : lo + p.batch]
            lens = bounds[pick + 1] - bounds[pick]
            at = np.repeat(bounds[pick] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            f, v = feature[at], value[at]
            own = np.repeat(np.arange(len(pick)), lens)
            margin = np.bincount(own, weights=w[f] * v, minlength=len(pick)) + w[size]
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[pick]) * weight[pick]
            used, back = np.unique(f, return_inverse=True)
            used = np.append(used, size)
            g = np.append(np.bincount(back, weights=error[own] * v, minlength=len(used) - 1), error.sum())
            z[used] += g - (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / p.alpha * w[used]
            n[used] += g * g
            zu = z[used]
            l1 = np.where(used == size, 0.0, p.l1)
            w[used] = np.where(np.abs(zu) <= l1, 0.0, -(zu - np.sign(zu) * l1) / ((p.beta + np.sqrt(n[used])) / p.alpha + p.l2))
    return w[:size].astype(np.float32), float(w[size])


def score_texts(column: pa.Array, weights: np.ndarray, bias: float, p: QualityParams) -> np.ndarray:
    out = np.full(len(column), -30.0)
    for first, buf, offsets in slices(column):
        rows, f = features(buf, offsets, p.bits)
        n = len(offsets) - 1
        count = np.bincount(rows, minlength=n)
        total = np.bincount(rows, weights=weights[f], minlength=n)
        some = count > 0
        out[first : first + n][some] = p.scale * total[some] / count[some] + bias
    return out


def train(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> tuple[np.ndarray, float]:
    """Fits in one task, so that the driver only receives the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, one = sample(batches)
        weights, bias = fit(texts, y, p, one)
        del texts
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], names=["weights", "bias"])

    got = labelled(docs, labels, "quality", p.sample_rows).repartition(1).mapInArrow(run, "weights binary, bias double").collect()
    return (np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"]) if got else (np.zeros(1 << p.bits, np.float32), 1.0)


def quality(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, the probability of good quality, and whether the text is kept, one row for each row of ``docs``.

    Null, empty and blank texts have the probability 0 and are not kept. Repeated rows are scored
    alike, a null doc_id is passed on, and other columns of ``docs`` don't matter. Without labels of both classes every
    text with a token is kept. Long texts are scored whole.
    """
    weights, bias = train(docs, labels, p)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def probability(text: pa.Array) -> pa.Array:
        margin = score_texts(text, model.value, bias, p)
        tidy()
        return pa.array(np.where(margin <= -30, 0.0, 1 / (1 + np.exp(-np.clip(margin, -29, 30)))))

    scored = docs.select("doc_id", probability(F.col("text")).alias("p"))
    return scored.select("doc_id", F.round("p", 6).alias("score"), (F.col("p") >= p.keep).alias("keep"))
