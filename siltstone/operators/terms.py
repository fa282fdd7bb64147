"""Terms of many texts at once, as arrays: lower-cased runs of letters and digits without Latin accents, named by 64-bit hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_END = "\U0010ffff"  # between texts; not a character, and part of no term
_ACCENTS = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_held: dict[str, np.ndarray] = {}


def _kinds(ascii: bool) -> tuple[np.ndarray, np.ndarray]:
    """What each code point is without its accent, and which are letters or digits; once a process. With ``ascii``, accents stay and only a-z and 0-9 count."""
    if "plain" not in _held:
        plain = np.arange(0x110000, dtype=np.uint32)
        _held["same"] = plain.copy()
        plain[list(_ACCENTS)] = list(_ACCENTS.values())
        _held["plain"], _held["inside"] = plain, np.fromiter((chr(k).isalnum() for k in range(0x110000)), bool, 0x110000)
        _held["ascii"] = _held["inside"] & (np.arange(0x110000) < 128)
    return (_held["same"], _held["ascii"]) if ascii else (_held["plain"], _held["inside"])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _held or len(_held["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BACK)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _held[name] = np.cumprod(steps, dtype=np.uint64)
    return _held["up"], _held["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, by in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(33))


class Terms:
    """Terms of a list of texts in order: ``rows`` (of the list), ``hashes``, and where they lie. Or, with ``ascii``, lower-cased runs of a-z and 0-9."""

    def __init__(self, texts: Sequence[str | None], ascii: bool = False):
        plain, inside = _kinds(ascii)
        joined = _END.join((t or "").replace(_END, " ") for t in texts).lower()
        self.chars = plain[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        on = np.concatenate([[False], inside[self.chars], [False]])
        edges = np.flatnonzero(on[1:] != on[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.rows = np.searchsorted(np.flatnonzero(self.chars == 0x10FFFF), self.starts)
        up, down = _powers(len(self.chars) + 1)
        sums = np.zeros(len(self.chars) + 1, np.uint64)
        np.cumsum((self.chars.astype(np.uint64) + np.uint64(1)) * up[: len(self.chars)], dtype=np.uint64, out=sums[1:])
        self.hashes = _mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])
        self.n = len(texts)

    def text(self, at: int) -> str:
        return self.chars[self.starts[at] : self.ends[at]].tobytes().decode("utf-32-le", "surrogatepass")

    def lengths(self) -> np.ndarray:
        return np.bincount(self.rows, minlength=self.n)


def hash_terms(words: Sequence[str]) -> np.ndarray:
    """Hashes of single terms, one each; what isn't a term by itself gets 0."""
    got = Terms(words)
    out = np.zeros(len(words), np.uint64)
    one = got.lengths() == 1
    mine = one[got.rows]
    out[got.rows[mine]] = got.hashes[mine]
    return out


class Md5:
    """The first 32 bits of the MD5 digest of terms, which are kept for those met so far."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.known, self.own = most, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, t: Terms) -> np.ndarray:
        h, one, back = np.unique(t.hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self.known, self.own = self.known[:0], self.own[:0]
        at = np.searchsorted(self.known, h)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != h) if len(self.known) else np.arange(len(h))
        if len(new):
            named = np.fromiter((int(md5(t.text(k).encode()).hexdigest()[:8], 16) for k in one[new].tolist()), np.int64, len(new))
            self.known, self.own = np.insert(self.known, at[new], h[new]), np.insert(self.own, at[new], named)
            at = np.searchsorted(self.known, h)
        return self.own[at][back] if len(h) else np.zeros(0, np.int64)


def slices(columns: Sequence[Sequence[str | None]], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many characters."""
    lo, size = 0, 0
    n = len(columns[0]) if columns else 0
    for k in range(n):
        size += sum(len(c[k] or "") for c in columns)
        if size >= most:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < n:
        yield lo, n


def chunk_slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, list[str | None]]]:
    """Of rows (chunk_id, title, text), by runs of so many bytes of text: ids, the different titles, which title each row has, and the texts.

    All chunks of a document have its title, which may be longer than they are; it is met once a run.
    """
    for b in batches:
        ids, coded = b.column(0).to_numpy(), b.column(1).dictionary_encode()
        which = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(ids):
            hi = min(len(ids), 1 + int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most)))
            used, of = np.unique(which[lo:hi], return_inverse=True)
            titles = [coded.dictionary[k].as_py() if k < len(coded.dictionary) else "" for k in used.tolist()]
            yield ids[lo:hi], titles, of, b.column(2).slice(lo, hi - lo).to_pylist()
            lo = hi


def gather(counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of so many elements that lie one after the other: the elements of the lists ``at``, and the place in ``at`` that each is for."""
    n = counts[at]
    own = np.repeat(np.arange(len(at)), n)
    first = np.cumsum(counts) - counts
    return own, np.arange(len(own)) + np.repeat(first[at] - (np.cumsum(n) - n), n)


def count_keys(titles: Terms, texts: Terms, of: np.ndarray, name: Callable[[Terms], np.ndarray], names: int, title: float = 1.0, text: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows, names and weighted counts of the terms in titles (each for the rows that have it) and texts. ``name`` gives each term a number below ``names``, or one below 0."""
    found = []
    for t in (titles, texts):
        own = name(t)
        on = own >= 0
        found.append(np.unique(t.rows[on] * names + own[on], return_counts=True))
    (key, n), (keys, counts) = found
    row, at = gather(np.bincount(key // names, minlength=titles.n), of)
    both, back = np.unique(np.concatenate([row * names + key[at] % names, keys]), return_inverse=True)
    weights = np.bincount(back, weights=np.concatenate([n[at] * title, counts * text]), minlength=len(both))
    return both // names, both % names, weights
