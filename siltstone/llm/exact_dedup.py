"""Exact dedup: a log-structured merge index of text digests.

Every task of the scan fills memtables of (digest, doc_id) and flushes them as sorted runs, cut at digest
prefixes, each piece with a Bloom filter. The pieces of a prefix meet in one task, which looks every new
piece up in the levels it holds (filters first), keeps the smallest identifier, and compacts a level into
the next one when it is full. Digests that were hit are then verified by the bytes of their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, packed, second_hash, small, text_hash
from .textbytes import tidy

NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id, which is thus kept last
_PAIR = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("id", "<i8")])


@dataclass(frozen=True)
class DedupParams:
    memtable_rows: int = 1 << 18
    prefix_rows: int = 1 << 20  # expected digests in one compaction task
    fanout: int = 4  # runs of a level before it is compacted into the next
    filter_bits: int = 10  # for each digest


class Filter:
    """A Bloom filter over digests, in numpy."""

    def __init__(self, run: np.ndarray | None = None, bits: int = 10, data: bytes | None = None):
        if data is not None:
            self.data = np.frombuffer(data, np.uint8)
        else:
            n = max(64, len(run) * bits)
            self.data = np.zeros((n + 7) // 8, np.uint8)
            for at in self._at(run):
                np.bitwise_or.at(self.data, at >> np.uint64(3), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def _at(self, run: np.ndarray) -> Iterator[np.ndarray]:
        size = np.uint64(len(self.data) * 8)
        for k in range(4):
            yield (run["lo"] + np.uint64(k) * (run["hi"] | np.uint64(1))) % size

    def may_hold(self, run: np.ndarray) -> np.ndarray:
        out = np.ones(len(run), dtype=bool)
        for at in self._at(run):
            out &= (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _sorted(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["id"], rows["lo"], rows["hi"]))]


def _same_as_before(rows: np.ndarray) -> np.ndarray:
    same = np.zeros(len(rows), dtype=bool)
    same[1:] = (rows["hi"][1:] == rows["hi"][:-1]) & (rows["lo"][1:] == rows["lo"][:-1])
    return same


def merge(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Compacts sorted runs: one row a digest, with the smallest identifier; and the digests that met."""
    rows = _sorted(np.concatenate(runs))
    again = _same_as_before(rows)
    return rows[~again], rows[again]


def find(run: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which digests of ``keys`` the sorted ``run`` holds; ``hi`` is searched, its equals are walked through."""
    found = np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(run["hi"], keys["hi"])
    open_ = np.arange(len(keys))
    while len(open_):
        open_ = open_[at[open_] < len(run)]
        open_ = open_[run["hi"][at[open_]] == keys["hi"][open_]]
        equal = run["lo"][at[open_]] == keys["lo"][open_]
        found[open_[equal]] = True
        open_ = open_[~equal]
        at[open_] += 1
    return found


class Index:
    """The levels of one digest prefix."""

    def __init__(self, p: DedupParams):
        self.p, self.levels, self.hits = p, [], []

    def add(self, run: np.ndarray, filter_: Filter) -> None:
        for level in self.levels:
            for held, f in level:
                maybe = run[f.may_hold(run)]
                if len(maybe):
                    self.hits.append(maybe[find(held, maybe)])
        self._put(0, run, filter_)

    def _put(self, at: int, run: np.ndarray, filter_: Filter) -> None:
        if len(self.levels) == at:
            self.levels.append([])
        self.levels[at].append((run, filter_))
        if len(self.levels[at]) >= self.p.fanout:
            merged, _ = merge([r for r, _ in self.levels[at]])
            self.levels[at] = []
            self._put(at + 1, merged, Filter(merged, self.p.filter_bits))

    def hit(self) -> np.ndarray:
        """Sorted rows of the digests that were hit, each with the smallest identifier of all."""
        runs = [r for level in self.levels for r, _ in level]
        if not runs or not self.hits:
            return np.zeros(0, _PAIR)
        full, _ = merge(runs)
        keys, _ = merge(self.hits)
        return full[find(keys, full)]


def flush(rows: np.ndarray, prefix_bits: int, p: DedupParams) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """A memtable as sorted runs: prefix, rows, digests that met in the memtable, filter."""
    run, met = merge([rows])
    shift = np.uint64(64 - prefix_bits)
    of = (run["hi"] >> shift).astype(np.int64) if prefix_bits else np.zeros(len(run), np.int64)
    of_met = (met["hi"] >> shift).astype(np.int64) if prefix_bits else np.zeros(len(met), np.int64)
    for prefix in np.unique(of):
        own = run[of == prefix]
        yield int(prefix), own.tobytes(), met[of_met == prefix].tobytes(), Filter(own, p.filter_bits).data.tobytes()


def repeated_digests(docs: DataFrame, hi: Column, lo: Column, p: DedupParams) -> DataFrame:
    """(__hi, __lo, __least): the digests that more than one row has, with their smallest identifier; checkpointed."""
    rows = docs.where(F.col("text").isNotNull()).select(
        hi.alias("__hi"), lo.alias("__lo"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("__id")
    )
    prefix_bits = min(20, max(3, math.ceil(math.log2(max(1, docs.count() / p.prefix_rows)))))

    def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            got = list(flush(np.concatenate(parts), prefix_bits, p))
            return pa.RecordBatch.from_arrays(
                [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["prefix", "run", "met", "filter"]
            )

        held, n = [], 0
        for b in batches:
            rows = np.empty(len(b), _PAIR)
            for k, name in enumerate(("hi", "lo")):
                rows[name] = b.column(k).to_numpy(zero_copy_only=False).view(np.uint64)
            rows["id"] = b.column(2).to_numpy(zero_copy_only=False)
            held.append(rows)
            n += len(rows)
            if n >= p.memtable_rows:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)
        del held
        tidy()

    def compact(pieces: pd.DataFrame) -> pd.DataFrame:
        index = Index(p)
        for run, met, data in zip(pieces["run"], pieces["met"], pieces["filter"]):
            if met:
                index.hits.append(np.frombuffer(met, _PAIR))
            index.add(np.frombuffer(run, _PAIR), Filter(data=data))
        got = index.hit()
        return pd.DataFrame({"__hi": got["hi"].view(np.int64), "__lo": got["lo"].view(np.int64), "__least": got["id"]})

    runs = rows.mapInArrow(memtables, "prefix long, run binary, met binary, filter binary")
    return cut(runs.groupBy("prefix").applyInPandas(compact, "__hi long, __lo long, __least long"))


def _classes(rows: DataFrame) -> DataFrame:
    """(__hi, __lo, __same, __keep): the texts among rows whose digest is repeated, with their smallest doc_id; checkpointed.

    Grouping by text compares bytes, and combines equal texts in every task before they are shuffled, so a text that a third of
    all rows have is one row of each task. __same is null, or, where different texts share a digest, the text.
    """
    texts = rows.groupBy("__hi", "__lo", "text").agg(F.min("doc_id").alias("__keep"))
    texts = cut(texts)
    mixed = small(cut(texts.groupBy("__hi", "__lo").agg(F.count("*").alias("__n")).where("__n > 1").select("__hi", "__lo", F.lit(True).alias("__mixed"))), 24)
    return texts.join(mixed, ["__hi", "__lo"], "left").select("__hi", "__lo", F.when(F.col("__mixed"), F.col("text")).alias("__same"), "__keep")


def _named(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with their text's __keep. Joined by digest; texts are only compared where the digest doesn't decide."""
    classes = small(classes, 48)
    on = [rows[c] == classes[c] for c in ("__hi", "__lo")]
    return rows.join(classes, [*on, classes["__same"].isNull() | (classes["__same"] == rows["text"])]).drop(classes["__hi"]).drop(classes["__lo"])


def exact_dedup(docs: DataFrame, p: DedupParams = DedupParams(), hi: Column | None = None, lo: Column | None = None) -> DataFrame:
    """doc_id and keep_id for every row that repeats the bytes of an earlier one.

    Of the rows with equal texts that with the smallest doc_id stays (one of them, if that is repeated)
    and is not returned; a null doc_id counts as the largest. Null texts are never duplicates, empty
    texts are of each other. Other columns don't matter. An empty table gives an empty result. Digests
    (``hi``, ``lo``) only choose what is compared: texts that share a digest and differ are kept apart.
    """
    hi, lo = hi if hi is not None else text_hash(F.col("text")), lo if lo is not None else second_hash(F.col("text"))
    seen = small(repeated_digests(docs, hi, lo, p), 40)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", hi.alias("__hi"), lo.alias("__lo"))
    met = rows.join(seen, ["__hi", "__lo"], "left_semi")
    named = _named(met, _classes(met)).select("doc_id", "__hi", "__lo", "__same", "__keep")
    stays = F.col("doc_id").eqNullSafe(F.col("__keep"))
    # of the rows that have the smallest identifier one stays
    again = named.where(stays).groupBy("__hi", "__lo", "__same", "__keep").agg(F.count("*").alias("__n")).where("__n > 1")
    again = again.select(F.col("__keep").alias("doc_id"), F.col("__keep").alias("keep_id"), F.explode(F.sequence(F.lit(2).cast("long"), "__n")))
    return named.where(~stays).select("doc_id", F.col("__keep").alias("keep_id")).unionAll(again.select("doc_id", "keep_id"))


def drop_exact(docs: DataFrame, p: DedupParams = DedupParams()) -> DataFrame:
    """``docs`` with one row for each text, chosen as :func:`exact_dedup` does; rows with null texts stay.

    Empty texts are equal to each other; a null doc_id counts as the largest. Of rows that are alike in text and doc_id any one stays.
    An empty table gives an empty result, and columns of any name are kept as they are.
    """
    hi, lo = text_hash(F.col("text")), second_hash(F.col("text"))
    seen = small(repeated_digests(docs, hi, lo, p), 40)
    rows = packed(docs).select("row", "row.doc_id", "row.text").withColumns({"__hi": hi, "__lo": lo})
    once = rows.join(seen, ["__hi", "__lo"], "left_anti")
    met = rows.where("text is not null").join(seen, ["__hi", "__lo"], "left_semi")
    first = _named(met, _classes(met.select("__hi", "__lo", "doc_id", "text"))).where(F.col("doc_id").eqNullSafe(F.col("__keep")))
    one = first.groupBy("__hi", "__lo", "__same").agg(F.first("row").alias("row"))
    return once.select("row.*").unionAll(one.select("row.*"))
