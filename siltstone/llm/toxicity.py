"""Toxicity: embeddings of character n-grams, averaged over a text, into a linear softmax.

Both layers are trained jointly, in numpy, on a bounded sample of labelled rows. Since a score is
linear in the averaged embedding, a trained model is folded into one number per n-gram bucket; scoring
then is a sum of looked-up numbers over the whole text. A misspelt word shares most n-grams with the
word it comes from, and so its vector. Characters are code points, lower-cased by Unicode's rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, lean
from .textbytes import _WORD, points, slices, tidy


@dataclass(frozen=True)
class ToxicityParams:
    """sample_rows bounds the labelled rows that are used for fitting: so many of each class at most.
    Of these, the share ``held`` is kept back to place the cut-off. blank: so many n-grams without a meaning are averaged
    in with each text's own, so that a few n-grams of a short text don't decide by chance."""

    sample_rows: int = 4000
    held: float = 0.25
    blank: int = 800
    least: int = 3
    most: int = 5
    bucket_bits: int = 18
    dims: int = 8
    epochs: int = 12
    batch: int = 64
    rate: float = 1.0
    seed: int = 11


def gram_buckets(chars: np.ndarray, least: int, most: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the start and the bucket of every n-gram of word characters, which may begin or end at a word's edge."""
    inside = _WORD[np.minimum(chars, 128)]
    flat = np.where(inside, chars, np.uint32(32))
    h = flat * np.uint32(0x01000193)
    ok = np.ones(len(flat), dtype=bool)
    for n in range(2, most + 1):
        if len(flat) < n:
            return
        m = len(flat) - n + 1
        h = (h[:m] ^ flat[n - 1 :]) * np.uint32(0x01000193)
        if n > 2:
            ok = ok[:m] & inside[n - 2 : n - 2 + m]
        else:
            ok = ok[:m]
        if n >= least:
            at = np.flatnonzero(ok)
            g = h[at] + np.uint32(n)
            g = (g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield at, (g ^ (g >> np.uint32(13))) >> np.uint32(32 - bits)


def _slices(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """:func:`slices` of lower-cased texts, as characters."""
    for first, buf, offsets in slices(pc.utf8_lower(column), limit):
        yield first, *points(buf, offsets)


def _bags(texts: list[str], p: ToxicityParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of all texts, by row and bucket: where rows begin, buckets, counts, and the rows' sums of counts.

    Counts take two bytes; a larger one is several entries of the same bucket.
    """
    parts: tuple[list, list] = ([], [])
    sizes, totals = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for lo in range(0, len(texts), 256):
        for at_row, chars, offsets in _slices(pa.array(texts[lo : lo + 256], pa.large_string()), 1 << 18):
            n, first = len(offsets) - 1, lo + at_row
            own = []
            for at, bucket in gram_buckets(chars, p.least, p.most, p.bucket_bits):
                rows = np.searchsorted(offsets, at, side="right") - 1
                own.append((rows.astype(np.int64) << p.bucket_bits) | bucket)
            if own:
                key, count = np.unique(np.concatenate(own), return_counts=True)
                if count.size and count.max() > 65535:
                    times = -(-count // 65535)
                    key, left = np.repeat(key, times), np.repeat(count, times)
                    place = np.arange(len(key)) - np.repeat(np.cumsum(times) - times, times)
                    count = np.minimum(left - 65535 * place, 65535)
                rows = key >> p.bucket_bits
                sizes[first : first + n] = np.bincount(rows, minlength=n)
                totals[first : first + n] = np.bincount(rows, weights=count, minlength=n)
                parts[0].append((key & ((1 << p.bucket_bits) - 1)).astype(np.int32))
                parts[1].append(count.astype(np.uint16))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return bounds, _joined(parts[0], np.int32), _joined(parts[1], np.uint16), (totals + p.blank).astype(np.float32)


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    """The parts in one array; they are let go on the way, so that memory doesn't double."""
    out, at = np.empty(sum(map(len, parts)), kind), 0
    parts.reverse()
    while parts:
        part = parts.pop()
        out[at : at + len(part)] = part
        at += len(part)
    return out


def fit(
    texts: list[str], labels: np.ndarray, p: ToxicityParams = ToxicityParams(), stands_for: tuple[float, float] = (1, 1)
) -> tuple[np.ndarray, float, float]:
    """Returns each bucket's share of the log odds, their bias, and the log odds from which a text is toxic.

    stands_for: how many labelled rows of class 0 and 1 one row of the sample stands for.
    """
    rng = np.random.default_rng(p.seed)
    size = 1 << p.bucket_bits
    y = np.asarray(labels, dtype=np.int64)
    if len(np.unique(y)) < 2:  # nothing to tell apart: nothing is toxic
        return np.zeros(size, np.float32), -1.0, 0.0
    bounds, bucket, count, total = _bags(texts, p)
    aside = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(y == label))
        aside[own[: int(len(own) * p.held)]] = True
    emb = rng.uniform(-0.5, 0.5, (size, p.dims)).astype(np.float32) / p.dims
    out = rng.uniform(-0.5, 0.5, (p.dims, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    emb_g, out_g, bias_g = np.full(size, 1e-8, np.float32), np.full_like(out, 1e-8), np.full_like(bias, 1e-8)
    used = np.flatnonzero(~aside)
    share = np.bincount(y[used], minlength=2) / len(used)
    for epoch in range(p.epochs):
        order = rng.permutation(used)
        rate = p.rate * (1 - epoch / p.epochs) + 0.01
        for lo in range(0, len(order), p.batch):
            pick = np.sort(order[lo : lo + p.batch])
            pick = pick[bounds[pick + 1] > bounds[pick]]
            if not len(pick):
                continue
            lens = bounds[pick + 1] - bounds[pick]
            at = np.repeat(bounds[pick] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            b, w = bucket[at], count[at] / np.repeat(total[pick], lens)
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            mean = np.add.reduceat(emb[b] * w[:, None], starts, axis=0)
            z = mean @ out + bias
            z -= z.max(1, keepdims=True)
            prob = np.exp(z)
            prob /= prob.sum(1, keepdims=True)
            delta = prob
            delta[np.arange(len(pick)), y[pick]] -= 1
            delta = delta * (0.5 / share[y[pick]])[:, None].astype(np.float32)
            to_mean = delta @ out.T
            g_out, g_bias = mean.T @ delta / len(pick), delta.mean(0)
            by = np.argsort(b, kind="stable")
            sb = b[by]
            cuts = np.flatnonzero(np.concatenate([[True], sb[1:] != sb[:-1]]))
            g = np.add.reduceat((w[:, None] * np.repeat(to_mean, lens, axis=0))[by], cuts, axis=0)
            u = sb[cuts]
            emb_g[u] += (g * g).mean(1)
            emb[u] -= rate * g / np.sqrt(emb_g[u])[:, None]
            out_g += g_out * g_out
            out -= rate * g_out / np.sqrt(out_g)
            bias_g += g_bias * g_bias
            bias -= rate * g_bias / np.sqrt(bias_g)
    table = (emb @ (out[:, 1] - out[:, 0])).astype(np.float32)
    table[emb_g <= 2e-8] = 0  # n-grams that were never seen say nothing
    shift = float(bias[1] - bias[0])
    score = np.full(len(y), -1e3)
    for row in np.flatnonzero(bounds[1:] > bounds[:-1]):
        own = slice(bounds[row], bounds[row + 1])
        score[row] = float(table[bucket[own]] @ count[own].astype(np.float32)) / total[row] + shift
    test = np.flatnonzero(aside) if len(np.unique(y[aside])) == 2 else np.arange(len(y))
    return table, shift, _cut_off(score[test], y[test], stands_for)


def _cut_off(score: np.ndarray, y: np.ndarray, stands_for: tuple[float, float]) -> float:
    """The log odds that part the rows with the best F1."""
    order = np.argsort(-score, kind="stable")
    weight = np.where(y == 1, stands_for[1], stands_for[0])
    hits = np.cumsum((y * weight)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + (y * weight).sum())
    best = int(np.argmax(f1))
    low = score[order[best]]
    return float((low + score[order[best + 1]]) / 2) if best + 1 < len(y) else float(low)


def score_texts(column: pa.Array, table: np.ndarray, shift: float, p: ToxicityParams) -> np.ndarray:
    out = np.zeros(len(column))
    for first, chars, offsets in _slices(column):
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        for at, bucket in gram_buckets(chars, p.least, p.most, p.bucket_bits):
            sums = np.concatenate([[0.0], np.cumsum(table[bucket], dtype=np.float64)])
            cuts = np.searchsorted(at, offsets)
            total += sums[cuts[1:]] - sums[cuts[:-1]]
            count += np.diff(cuts)
        out[first : first + n] = total / (count + p.blank) + np.where(count > 0, shift, -1e3)
    return out


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Texts, labels and class sizes (``__text``, ``__y``, ``__of``) of at most ``rows`` rows a class: those whose identifiers hash lowest.

    Rows without identifier or label are not used; an identifier with several labels takes the largest,
    one with several texts the first in order.
    """
    lean(docs.sparkSession)
    ids = (
        labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y"))
        .where("__id is not null and __y in (0, 1)")
        .groupBy("__id")
        .agg(F.max("__y").alias("__y"))
        .withColumn("__h", F.xxhash64("__id", F.lit(17)))
    )
    ids = cut(ids)
    pick = None
    for y in (0, 1):
        of = ids.where(F.col("__y") == y)
        part = of.orderBy("__h", "__id").limit(rows).withColumn("__of", F.lit(of.count()))
        pick = part if pick is None else pick.unionAll(part)
    pick = cut(pick)  # at most 2 x rows identifiers: a bounded broadcast
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).where("__text is not null")
    return texts.join(F.broadcast(pick), "__id").groupBy("__id", "__y", "__of").agg(F.min("__text").alias("__text"))


def sample(batches: Iterator[pa.RecordBatch]) -> tuple[list[str], np.ndarray, tuple[float, float]]:
    """Of the rows of :func:`labelled`: texts and labels in the order of identifiers, and how many labelled rows one of each class stands for."""
    rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))  # __id, __y, __of, __text
    y = np.array([r[1] for r in rows], np.int64)
    one = tuple(max((r[2] for r in rows if r[1] == k), default=1) / max((y == k).sum(), 1) for k in (0, 1))
    return [r[3] for r in rows], y, one


def train(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> tuple[np.ndarray, float, float]:
    """Fits in one task, so that the driver only receives the folded model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, one = sample(batches)
        table, shift, least = fit(texts, y, p, one)
        del texts
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()]), pa.array([shift]), pa.array([least])], names=["model", "shift", "least"])

    rows = labelled(docs, labels, "toxic", p.sample_rows)
    got = rows.repartition(1).mapInArrow(run, "model binary, shift double, least double").collect()
    if not got:
        return np.zeros(1 << p.bucket_bits, np.float32), -1.0, 0.0
    return np.frombuffer(got[0]["model"], np.float32), got[0]["shift"], got[0]["least"]


def log_odds(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()):
    """A function from a text column to the log odds above the cut-off: toxic from 0 on."""
    table, shift, least = train(docs, labels, p)
    model = docs.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("double")
    def above(text: pa.Array) -> pa.Array:
        out = pa.array(score_texts(text, model.value, shift, p) - least)
        tidy()
        return out

    return above


def toxicity(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, the log odds above the cut-off, and whether the text is toxic, one row for each row of ``docs``.

    Null, empty and letterless texts are not toxic. Repeated rows are scored alike, a null doc_id is
    passed on, and other columns of ``docs`` don't matter. Without labels of both classes nothing is
    toxic. Long texts are scored whole.
    """
    above = log_odds(docs, labels, p)
    scored = docs.select("doc_id", above(F.col("text")).alias("score"))
    return scored.select("doc_id", F.round(F.greatest("score", F.lit(-100.0)), 6).alias("score"), (F.col("score") >= 0).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The rows of ``docs`` that :func:`toxicity` does not reject, with all their columns, whatever these are named.

    Null, empty and letterless texts stay, repeated rows stay or go together; without labels of both classes all rows stay.
    """
    above = log_odds(docs, labels, p)
    return docs.where(above(F.col("text")) < 0)
