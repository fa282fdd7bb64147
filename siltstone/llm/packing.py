"""Best-fit packing of documents into sequences of fixed capacity, by bin completion.

A document longer than the capacity fills whole sequences; what is left of it is packed like a short
one. Pieces are packed in shards. In a shard, best fit decreasing gives the first incumbent. If it needs more bins
than the lower bound, bins are completed one by one around the largest piece left: the undominated
fillings are enumerated in the order of their waste, on demand, and followed depth first; a branch ends as soon as the waste so far
shows that it can't beat the incumbent.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, lean
from .textbytes import tidy
from .token_counts import TokenParams, counter


@dataclass(frozen=True)
class PackParams:
    """vocabulary: a rank file by whose tokens to count; None: words. shard_pieces is about how many documents are packed together.
    max_steps bounds the search of a shard in fillings that are looked at; where it ends the search, the incumbent stands,
    which is never worse than best fit decreasing."""

    capacity: int = 2048
    vocabulary: str | None = TokenParams().vocabulary
    shard_pieces: int = 2048
    max_steps: int = 4000
    seed: int = 5


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing; bins as lists of positions. Equal sizes keep their order."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # sorted (room, bin)
    for at in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_right(room, (sizes[at] - 1, len(sizes)))
        if k < len(room):
            left, b = room.pop(k)
            bins[b].append(at)
        else:
            left, b = capacity, len(bins)
            bins.append([at])
        insort(room, (left - sizes[at], b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Martello and Toth's L2: pieces that can't share a bin, and the waste they force."""
    s = np.sort(np.asarray(sizes, np.int64))[::-1]
    total = np.concatenate([[0], np.cumsum(s)])
    best = -(-int(total[-1]) // capacity)
    mid = int(np.searchsorted(-s, -(capacity / 2), side="left"))  # > capacity / 2
    k = np.unique(s[2 * s <= capacity])
    if len(k):
        big = np.searchsorted(-s, k - capacity, side="left")  # > capacity - k
        low = np.searchsorted(-s, -k, side="right")  # >= k
        free = (mid - big) * capacity - (total[mid] - total[big])
        best = max(best, mid + max(0, int((-(-(total[low] - total[mid] - free) // capacity)).max())))
    return max(best, mid)


def fillings(counts: dict[int, int], room: int) -> Iterator[tuple[int, tuple[int, ...] | None]]:
    """The undominated ways to fill ``room`` from sizes with counts, with the waste that they leave, tightest first; None for each dominated one.

    A filling is dominated if another size that fits in could be added, or if one of its pieces could
    be swapped for a larger one that is left over and still fits. Sums that can be reached are known from a
    table of bits, so no way that leads nowhere is tried.
    """
    order = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    have = [counts[s] for s in order]
    mask = (1 << (room + 1)) - 1
    reach = [1] * (len(order) + 1)  # sums of pieces from a size on
    for i in range(len(order) - 1, -1, -1):
        r, left, n = reach[i + 1], have[i], 1
        while left:
            n = min(n, left)
            r |= r << (n * order[i]) & mask
            left, n = left - n, 2 * n
        reach[i] = r

    def ways(i: int, total: int) -> Iterator[tuple[tuple[int, int], ...]]:
        if not total:
            yield ()
            return
        for j in range(i, len(order)):
            if not reach[j] >> total & 1:
                return
            size = order[j]
            for n in range(min(have[j], total // size), 0, -1):
                if reach[j + 1] >> (total - n * size) & 1:
                    for more in ways(j + 1, total - n * size):
                        yield ((j, n), *more)

    for total in range(room, -1, -1):
        if not reach[0] >> total & 1:
            continue
        left = room - total
        for way in ways(0, total):
            used = dict(way)
            filling = tuple(order[j] for j, n in way for _ in range(n))
            if left:
                spare = [s for j, s in enumerate(order) if have[j] > used.get(j, 0)]
                if spare and spare[-1] <= left or any(order[j] < v <= order[j] + left for j in used for v in spare):
                    filling = None
            yield left, filling


def bin_completion(sizes: list[int], capacity: int, p: PackParams = PackParams()) -> list[list[int]]:
    """Bins as lists of positions: the fewest that were found, and the fewest there are if the search wasn't cut short."""
    return searched(sizes, capacity, p)[0]


def searched(sizes: list[int], capacity: int, p: PackParams = PackParams()) -> tuple[list[list[int]], bool]:
    """The bins, and whether the search ended at ``max_steps``."""
    best = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if len(best) <= bound:
        return best, False
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    zero = counts.pop(0, 0)
    total, left, steps, target = sum(sizes), len(sizes) - zero, 0, len(best)
    answer: list[tuple[int, ...]] | None = None
    path: list[tuple[int, ...]] = []

    def begin() -> tuple[int, Iterator]:
        largest = max(s for s, n in counts.items() if n)
        return largest, fillings({s: n - (s == largest) for s, n in counts.items()}, capacity - largest)

    def take(f: tuple[int, ...], sign: int) -> None:
        nonlocal left
        for s in f:
            counts[s] -= sign
        left -= sign * len(f)

    stack, wasted = [begin()], [0]
    while stack and steps < p.max_steps and target > bound:
        largest, ways = stack[-1]
        waste, f = next(ways, (None, None))
        # fillings come tightest first, so the first that is too loose ends them all
        if waste is None or -(-(total + wasted[-1] + waste) // capacity) >= target or len(path) + 1 >= target:
            stack.pop()
            wasted.pop()
            if path:
                take(path.pop(), -1)
            continue
        steps += 1
        # bins around equal pieces come in the order of their fillings, so that no set of bins is tried in several orders
        if f is None or path and path[-1][0] == largest and (waste, [-s for s in f]) < (capacity - sum(path[-1]), [-s for s in path[-1][1:]]):
            continue
        f = (largest, *f)
        take(f, 1)
        path.append(f)
        if left == 0:
            answer, target = list(path), len(path)
            take(path.pop(), -1)
            continue
        stack.append(begin())
        wasted.append(wasted[-1] + waste)
    if answer is None:
        return best, steps >= p.max_steps
    places: dict[int, list[int]] = {}
    for at in range(len(sizes) - 1, -1, -1):
        places.setdefault(sizes[at], []).append(at)
    out = [[places[s].pop() for s in f] for f in answer]
    if zero:
        out[0].extend(reversed(places[0]))
    return out, steps >= p.max_steps and target > bound


def pack(docs: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """One row a piece: shard, bin, place, doc_id, start, tokens, of documents cut at the capacity and packed.

    ``start`` is the piece's first token in its document; a bin's tokens sum to the capacity at most. A
    document with more than one row is packed as often as it has rows. Null and empty texts (and blank ones, if words are
    counted) have no tokens and are not packed. A null doc_id is packed like others, being the largest. Ties between
    pieces of equal size go by doc_id, then start. Other columns don't matter; an empty table gives an empty result.
    """
    lean(docs.sparkSession)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), counter(p.vocabulary)(F.col("text")).alias("n"))
    # rows that are alike go together, and are parted again into runs, so that no identifier makes a shard large; a filter
    # before the checkpoint would be pushed below the counts, which then were made twice, in two workers a task
    sized = cut(sized.groupBy("doc_id", "n").agg(F.count("*").alias("m"))).where("n > 0")
    shards = max(1, round((sized.agg(F.sum("m")).first()[0] or 0) / p.shard_pieces))
    run = max(1, p.shard_pieces // 8)
    runs = sized.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / run))))
    shard = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "n", "run", F.lit(p.seed)), F.lit(shards)).cast("long")
    runs = runs.select("doc_id", "n", F.least(F.lit(run), F.col("m") - F.col("run") * run).alias("times"), shard.alias("shard"))

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.loc[rows.index.repeat(rows["times"])]
        rows = rows.sort_values(["doc_id", "n"], kind="stable", na_position="last").reset_index(drop=True)
        n = rows["n"].to_numpy(np.int64)
        whole, rest = n // p.capacity, n % p.capacity
        at = np.repeat(np.arange(len(n)), whole)  # whole sequences, one bin each
        k = np.arange(len(at)) - np.repeat(np.cumsum(whole) - whole, whole)
        some = np.flatnonzero(rest)
        bins = bin_completion(rest[some].tolist(), p.capacity, p)
        lens = np.array([len(b) for b in bins], np.int64)
        flat = some[np.array([i for b in bins for i in b], np.int64)]
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        doc = np.concatenate([at, flat])
        tidy()
        return pd.DataFrame(
            {
                "shard": rows["shard"].to_numpy()[doc],
                "bin": np.concatenate([np.arange(len(at)), len(at) + np.repeat(np.arange(len(bins)), lens)]),
                "place": np.concatenate([np.zeros(len(at), np.int64), place]),
                "doc_id": rows["doc_id"].astype("Int64").to_numpy(dtype=object)[doc],
                "start": np.concatenate([k * p.capacity, (whole * p.capacity)[flat]]),
                "tokens": np.concatenate([np.full(len(at), p.capacity), rest[flat]]),
            }
        )

    schema = "shard long, bin long, place long, doc_id long, start long, tokens long"
    # packing is slow for the bytes it takes, so shards aren't merged into few tasks by their size
    return runs.repartition(min(shards, 100_000), "shard").groupBy("shard").applyInPandas(pack_shard, schema)
