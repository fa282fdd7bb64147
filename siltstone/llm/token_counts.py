"""Token counts by a map-side two-tier lookup.

Pre-tokens repeat a lot. A first pass counts them in every task, in bounded summaries that are thinned
there and merged in the driver; the lengths of the most frequent ones, in tokens, go into a compact hash table (arrays of 64-bit
hashes and lengths), which is broadcast. A second pass looks every pre-token up; misses are encoded, each once, and kept in a
cache of the worker, a table of the same kind. No pre-token is shuffled. Texts are split and looked up as arrays, not piece by piece.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, word_count
from .textbytes import points, span_hashes, tidy

#: How texts are split before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE_BYTES = 1 << 18


@dataclass(frozen=True)
class TokenParams:
    """vocabulary is a file of ranks (a base64 token and its rank a line). summary bounds the pre-tokens that a task counts
    at a time, table those of the broadcast table, cache those that a worker remembers; none of them changes a count."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    summary: int = 100_000
    collected: int = 400_000  # entries of all summaries together that the driver gets; one at least of a task
    table: int = 65_536
    cache: int = 1_000_000


_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(path: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file, once a process."""
    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


_LETTER, _NUMBER, _SPACE, _OTHER, _UNKNOWN = range(1, 6)
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of every code point, once a process; _UNKNOWN: not assigned, so that another version of Unicode may see it otherwise."""
    if not _kinds:
        every = "".join(map(chr, range(0x110000)))
        out = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+"), (_UNKNOWN, r"\p{Cn}+")):
            for m in regex.finditer(pattern, every):
                out[m.start() : m.end()] = kind
        _kinds.append(out)
    return _kinds[0]


def raw_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of about SLICE_BYTES: the first row's number, the bytes, and the rows' offsets in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, row + 1), len(column))
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def split(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """PATTERN's pieces of a slice: rows, first and last byte, and the rows that hold a code point of no known kind."""
    chars, begins = points(buf, offsets)
    n = len(chars)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    kind = kinds()[chars]
    first = np.zeros(n + 1, dtype=bool)  # a row begins, or all are over
    first[begins] = True
    odd = np.flatnonzero(kind == _UNKNOWN)
    if len(odd):
        kind[odd] = _OTHER
    edge = first[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    start = edge.copy()
    # of a run of spaces before something else the last is a piece of its own, or, being a blank, belongs to what follows
    runs = np.flatnonzero(edge)
    after = np.append(runs[1:], n)
    spaces = (kind[runs] == _SPACE) & ~first[after]
    after = after[spaces]
    start[after - 1] = True
    start[after[chars[after - 1] == 32]] = False
    # contractions, where a piece begins with an apostrophe
    quote = np.flatnonzero((chars == 39) & start)
    quote = quote[~first[quote + 1]]
    second = chars[quote + 1]
    short = quote[np.isin(second, [ord(c) for c in "stmd"])]
    start[short + 1] = False
    start[short[short + 2 < n] + 2] = True
    quote = quote[~first[np.minimum(quote + 2, n)]]
    second, third = chars[quote + 1], chars[np.minimum(quote + 2, n - 1)]
    long = quote[((second == ord("r")) | (second == ord("v"))) & (third == ord("e")) | (second == ord("l")) & (third == ord("l"))]
    start[long + 1] = False
    start[long[long + 3 < n] + 3] = True
    at = np.flatnonzero(start)
    rows = np.searchsorted(begins, at, side="right") - 1
    ends = np.append(at[1:], n)
    unknown = np.unique(np.searchsorted(begins, odd, side="right") - 1)
    if n != len(buf):
        byte = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
        at, ends = byte[at], byte[ends]
    return rows, at, ends, unknown


class Table:
    """Lengths by hash, in two arrays with open addressing."""

    def __init__(self, room: int = 1 << 10):
        self.keys, self.values, self.used = np.zeros(room, np.uint64), np.zeros(room, np.int32), 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which hashes are there; no hash is 0."""
        mask = np.uint64(len(self.keys) - 1)
        at = h & mask
        key, out = self.keys[at], self.values[at]
        there = key == h
        open_ = np.flatnonzero(~there & (key != 0))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & mask
            key = self.keys[at[open_]]
            same = key == h[open_]
            out[open_[same]], there[open_[same]] = self.values[at[open_[same]]], True
            open_ = open_[~same & (key != 0)]
        return out, there

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Distinct hashes that aren't there."""
        self.used += len(h)
        if 2 * self.used > len(self.keys):
            on = self.keys != 0
            h, values = np.concatenate([self.keys[on], h]), np.concatenate([self.values[on], values])
            room = 1 << int(2 * self.used - 1).bit_length()
            self.keys, self.values = np.zeros(room, np.uint64), np.zeros(room, np.int32)
        mask = np.uint64(len(self.keys) - 1)
        at, left = h & mask, np.arange(len(h))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            slot, one = np.unique(at[free], return_index=True)
            self.keys[slot], self.values[slot] = h[free[one]], values[free[one]]
            left = left[self.keys[at[left]] != h[left]]
            at[left] = (at[left] + np.uint64(1)) & mask


def hashed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = span_hashes(buf, starts, ends)
    h[h == 0] = 1
    return h


class Lengths:
    """The two tiers: a table of frequent pre-tokens and a cache of others, which is emptied when it is full."""

    def __init__(self, table: Table, p: TokenParams):
        self.table, self.cache, self.p, self.enc = table, Table(), p, encoder(p.vocabulary)

    def count(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column), np.int64)
        for first, buf, offsets in raw_slices(column):
            rows, starts, ends, unknown = split(buf, offsets)
            if not len(rows):
                continue
            h = hashed(buf, starts, ends)
            n, there = self.table.find(h)
            miss = np.flatnonzero(~there)
            n[miss], there = self.cache.find(h[miss])
            miss = miss[~there]
            if len(miss):
                new, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
                own = np.array([len(self.enc._encode_single_piece(buf[a:b].tobytes())) for a, b in zip(starts[miss[one]].tolist(), ends[miss[one]].tolist())], np.int32)
                n[miss] = own[back]
                if self.cache.used + len(new) > self.p.cache:
                    self.cache = Table()
                self.cache.add(new, own)
            out[first : first + len(offsets) - 1] = np.bincount(rows, weights=n, minlength=len(offsets) - 1)
            for row in unknown:  # the tokenizer itself decides
                out[first + row] = len(self.enc.encode_ordinary(buf[offsets[row] : offsets[row + 1]].tobytes().decode()))
        return out


_lengths: dict[str, Lengths] = {}


def lengths(key: str, table: Table, p: TokenParams) -> Lengths:
    """Of this process, for one query at a time."""
    if key not in _lengths:
        _lengths.clear()
        _lengths[key] = Lengths(table, p)
    return _lengths[key]


def counter(vocabulary: str | None):
    """A function from a text column to its tokens by a rank file (looked up in worker caches alone), or to its words if there is none;
    null and empty texts have 0."""
    if vocabulary is None:
        return word_count
    p = TokenParams(vocabulary=vocabulary)

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        out = lengths(f"cache of {vocabulary}", Table(), p).count(texts)
        tidy()
        return pa.array(out)

    return count


class Summary:
    """Misra-Gries over hashes: counts of the pre-tokens that are frequent; what is rare is forgotten at times."""

    def __init__(self, size: int):
        self.size = size
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.n = 0

    def add(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        h, one, n = np.unique(hashed(buf, starts, ends), return_index=True, return_counts=True)
        starts, lens = starts[one], (ends - starts)[one]
        upto = np.cumsum(lens)
        data = buf[np.arange(upto[-1]) + np.repeat(starts - upto + lens, lens)]
        pieces = pa.Array.from_buffers(pa.large_binary(), len(h), [None, pa.py_buffer(np.append(0, upto)), pa.py_buffer(data)])
        self.held.append((h, n, pieces))
        self.n += len(h)
        if self.n > 4 * self.size:
            self._merge()

    def _merge(self) -> None:
        if not self.held:
            return
        h, one, back = np.unique(np.concatenate([x for x, _, _ in self.held]), return_index=True, return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([x for _, x, _ in self.held])).astype(np.int64)
        pieces = pa.concat_arrays([x for _, _, x in self.held])
        if len(n) > 2 * self.size:
            least = np.partition(n, len(n) - self.size - 1)[len(n) - self.size - 1]
            on = n > least
            h, one, n = h[on], one[on], n[on] - least
        self.held, self.n = [(h, n, pieces.take(pa.array(one)))], len(h)

    def top(self, most: int) -> list[tuple[str, int]]:
        self._merge()
        if not self.held:
            return []
        _, n, pieces = self.held[0]
        best = np.argsort(-n, kind="stable")[:most]
        return sorted(zip((x.decode() for x in pieces.take(pa.array(best)).to_pylist()), n[best].tolist()), key=lambda x: (-x[1], x[0]))


def frequent(docs: DataFrame, p: TokenParams) -> Table:
    """Lengths in tokens of the pre-tokens that are most frequent in all documents."""
    lean(docs.sparkSession)
    texts = docs.select("text").where("text is not null")
    each = max(1, min(20_000, p.collected // max(1, texts.rdd.getNumPartitions())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Summary(p.summary)
        for b in batches:
            for _, buf, offsets in raw_slices(b.column(0)):
                _, starts, ends, _ = split(buf, offsets)
                if len(starts):
                    own.add(buf, starts, ends)
            tidy()
        top = own.top(each)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([v for _, v in top], pa.int64())], names=["piece", "n"])

    # one summary a task, bounded in all by p.collected
    total = texts.mapInArrow(count, "piece string, n long").toArrow().group_by("piece").aggregate([("n", "sum")])
    best = sorted(zip(total["n_sum"].to_pylist(), total["piece"].to_pylist()), key=lambda x: (-x[0], x[1]))[: p.table]
    enc, table = encoder(p.vocabulary), Table()
    if best:
        data = [piece.encode() for _, piece in best]
        ends = np.cumsum([len(x) for x in data])
        h, one = np.unique(hashed(np.frombuffer(b"".join(data), np.uint8), ends - [len(x) for x in data], ends), return_index=True)
        table.add(h, np.array([len(enc.encode_ordinary(best[k][1])) for k in one], np.int32))
    return table


def token_counts(docs: DataFrame, p: TokenParams = TokenParams()) -> DataFrame:
    """doc_id and n_tokens, one row for each row of ``docs``.

    Null and empty texts have 0 tokens. Repeated rows are counted alike, a null doc_id is passed on, other columns
    don't matter, an empty table gives an empty result. Strings that look like special tokens are
    ordinary text. Long texts, and long runs without a space, are counted whole.
    """
    table, key = docs.sparkSession.sparkContext.broadcast(frequent(docs, p)), uuid.uuid4().hex

    @F.arrow_udf("long")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = lengths(key, table.value, p)
        for column in texts:
            yield pa.array(own.count(column))
            tidy()

    return docs.select("doc_id", count(F.col("text")).alias("n_tokens"))
