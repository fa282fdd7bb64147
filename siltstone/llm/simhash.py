"""SimHash near-dedup by meet-in-the-middle ball hashing.

A text has a SimHash of 256 bits over its set of words, of which each table takes ``bits`` as its fingerprint. A fingerprint emits
itself and all its variants at distance 1, half the radius of 2: two fingerprints within the radius meet
at a variant, whatever bits they differ in. Variants are not shuffled: of three runs of a fingerprint's bits, two fingerprints within the
radius have at least one in common, so each run names a cell, a text's SimHash goes to these three, and variants in the other bits are
made and met there, a cell at a time. Texts that meet
are verified at once by the distance of their whole SimHash, so that of texts that meet by chance, whose number grows faster than the
input, nothing leaves the task; in a bucket every member is compared with a leader, and those that fail find another leader
among themselves, so large buckets need neither a cap nor all pairs. What has one fingerprint is led in the task that
sends it, so that of a large group of copies few are shuffled to a cell. Verified pairs are joined to components,
in which members are led once more, so that every text of a group is a verified near copy of the one that stays.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, lean, packed, small, text_hash
from .textbytes import lower, mix, slices, tidy, words

WORDS = 4  # 64-bit words of a whole SimHash
BITS = 64 * WORDS
ROUND = 6  # tables whose cells are shuffled at once
KEYS = 1 << 22  # keys that are sorted at once
HEADS = 64  # leaders of a bucket that are found one by one; then as many at once
_NODE = np.dtype([("id", "<i8"), ("s", "<u8", WORDS)])
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


@dataclass(frozen=True)
class SimHashParams:
    """bits: of a table's fingerprint; wider ones meet by chance more seldom and need more tables. apart is the largest share of
    differing bits of a verified pair, recall the share of pairs that far apart that must meet; the number of tables follows from
    these three alone. group: members of a component that are led in one row. cell: about how many SimHashes of a table meet in one cell;
    it changes no result."""

    bits: int = 32
    recall: float = 0.92
    apart: float = 0.17
    group: int = 20_000
    cell: int = 32_768

    @property
    def tables(self) -> int:
        meets = sum(math.comb(self.bits, k) * self.apart**k * (1 - self.apart) ** (self.bits - k) for k in range(3))
        return math.ceil(math.log(1 - self.recall) / math.log(1 - meets))


def simhashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The whole SimHash of every text (n x WORDS), and which texts have a word at all."""
    out, some = np.zeros((len(column), WORDS), np.uint64), np.zeros(len(column), dtype=bool)
    for first, buf, offsets in slices(column, 1 << 19):
        rows, hashes = words(lower(buf), offsets)
        if not len(rows):
            continue
        key = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        rows = (key >> np.uint64(44)).astype(np.int64)
        own, starts = np.unique(rows, return_index=True)
        bounds = np.concatenate([starts, [len(key)]])
        core = key & np.uint64((1 << 44) - 1)
        votes = np.zeros((len(own), BITS), np.int32)
        # eight bits are counted at once, in the bytes of a 64-bit number, which hold the sums of up to 255 words
        per = -(-np.diff(bounds) // 255)
        of = np.repeat(np.arange(len(own)), per)
        cuts = bounds[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per))
        for lo in range(0, len(cuts), 64):
            hi = min(lo + 64, len(cuts))
            end = cuts[hi] if hi < len(cuts) else len(core)
            part = core[cuts[lo] : end]
            parts = np.stack([mix(part + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) for k in range(WORDS)], axis=1)
            sums = np.add.reduceat(_LANES[parts.view(np.uint8)], cuts[lo:hi] - cuts[lo], axis=0)
            np.add.at(votes, of[lo:hi], sums.view(np.uint8))
        n = np.diff(bounds)[:, None]
        out[first + own] = np.packbits(2 * votes > n, axis=1).view(np.uint64)
        some[first + own] = True
    return out, some


def balls(sims: np.ndarray, bits: int, tables: int, first: int = 0) -> np.ndarray:
    """n x tables x (bits + 1): each fingerprint of the tables from ``first`` on and its variants at distance 1, hashed together with the table's number:
    what :func:`buckets` meets by, made outright."""
    flips = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int64)]).astype(np.uint64)
    out = np.empty((len(sims), tables, bits + 1), np.uint64)
    for t in range(tables):
        salt = mix(np.array([first + t + 1], np.uint64))
        out[:, t] = mix(fingerprint(sims, first + t, bits)[:, None] ^ flips ^ salt)
    return out


def fingerprint(sims: np.ndarray, table: int, bits: int) -> np.ndarray:
    """The bits of one table: consecutive ones of the whole SimHash as far as it goes, then seeded choices of its bits."""
    if (table + 1) * bits <= BITS:
        pick = np.arange(table * bits, (table + 1) * bits)
    else:
        pick = np.sort(np.random.default_rng(table).choice(BITS, bits, replace=False))
    out = np.zeros(len(sims), np.uint64)
    for k, b in enumerate(pick):
        out |= ((sims[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(k)
    return out


def targets(prints: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and cells, in the order of cells: where each fingerprint goes, which is to one cell for each of its first three runs of ``depth`` bits; all to cell 0 if depth is 0."""
    runs = np.arange(3 if depth else 1, dtype=np.uint64)
    cells = (prints[:, None] >> runs * np.uint64(depth) & np.uint64((1 << depth) - 1) | runs << np.uint64(depth)).reshape(-1)
    order = np.argsort(cells, kind="stable")
    return order // len(runs), cells[order].astype(np.int64)


def buckets(prints: np.ndarray, bits: int, depth: int, cell: int, keys: int = KEYS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the fingerprints that went to a cell, offsets and positions (ascending) of those that share a variant whose bits differ
    outside of the cell's run; equal lists once. About ``keys`` variants are held at a time, a part of the cell after the other."""
    run = range((cell >> depth) * depth, (cell >> depth) * depth + depth)
    flips = [0, *(1 << k for k in range(bits) if k not in run)]
    low = np.uint64(max(1, len(prints) - 1).bit_length())
    if bits + int(low) > 64:
        raise ValueError(f"{len(prints)} fingerprints of {bits} bits are too many for a cell")
    every, parts = np.arange(len(prints), dtype=np.uint64), -(-len(prints) * len(flips) // keys)
    for part in range(parts):
        made = []
        for flip in flips:
            key, at = prints ^ np.uint64(flip), every
            if parts > 1:
                on = mix(key) % np.uint64(parts) == np.uint64(part)
                key, at = key[on], at[on]
            made.append(key << low | at)
        made = np.concatenate(made)
        made.sort()
        key = made >> low
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        del key
        starts, lens = edge[:-1], np.diff(edge)
        some = lens > 1
        starts, lens = starts[some], lens[some]
        at = (made[np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        del made
        if not len(at):
            continue
        # a name of the set and its size: two sets of one name are the same
        starts = np.cumsum(lens) - lens
        name = mix(np.add.reduceat(mix(at.astype(np.uint64) + np.uint64(1)), starts) ^ lens.astype(np.uint64))
        first = np.sort(np.unique(name, return_index=True)[1])
        starts, lens = starts[first], lens[first]
        yield np.concatenate([[0], np.cumsum(lens)]), at[np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]


def lead(offsets: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """For each member of each bucket the position of its leader: the bucket's first member, then the first of those too far
    from all leaders so far, and so on."""
    leader = np.full(len(sims), -1)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    open_ = np.arange(len(sims))
    for _ in range(HEADS):
        if not len(open_):
            return leader
        own = of[open_]
        first = open_[np.concatenate([[True], own[1:] != own[:-1]])]
        to = first[np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))]
        far = np.bitwise_count(sims[open_] ^ sims[to]).sum(1) > most
        leader[open_[~far]] = to[~far]
        open_ = open_[far]
    # the few buckets of many leaders: the next of them at once
    for mine in np.split(open_, np.flatnonzero(np.diff(of[open_])) + 1):
        while len(mine):
            heads = mine[:HEADS]
            close = np.bitwise_count(sims[heads][:, None] ^ sims[heads]).sum(2) <= most
            on: list[int] = []
            for k in range(len(heads)):
                if not close[k, on].any():
                    on.append(k)
            left = []
            for lo in range(0, len(mine), 4096):
                some = mine[lo : lo + 4096]
                near = np.bitwise_count(sims[some][:, None] ^ sims[heads[on]]).sum(2) <= most
                found = near.any(1)
                leader[some[found]] = heads[on][near[found].argmax(1)]
                left.append(some[~found])
            mine = np.concatenate(left)
    return leader


_SIMS = ", ".join(f"__s{k} long" for k in range(WORDS))


def sketches(docs: DataFrame) -> DataFrame:
    """(__id, __h, __s0..): one row for each doc_id and text hash of a text with words; __n counts its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims, some = simhashes(b.column(2))
            tidy()
            keep = pa.array(some)
            cols = [b.column(0).filter(keep), b.column(1).filter(keep), *(pa.array(sims[some, k].view(np.int64)) for k in range(WORDS))]
            yield pa.RecordBatch.from_arrays(cols, names=["__id", "__h", *(f"__s{k}" for k in range(WORDS))])

    lean(docs.sparkSession)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("__id"), text_hash(F.col("text")).alias("__h"), "text")
    made = rows.mapInArrow(run, f"__id long, __h long, {_SIMS}")
    sims = [f"__s{k}" for k in range(WORDS)]
    return made.groupBy("__id", "__h", *sims).agg(F.count("*").alias("__n"))


def groups(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """(__id, __h, __n, __to, __first): rows of :func:`sketches`; __to is equal within a group, __first marks the row that stays. Checkpointed."""
    sims = [f"__s{k}" for k in range(WORDS)]
    rows = cut(sketches(docs))
    order = F.struct(F.coalesce("__id", F.lit(2**63 - 1)).alias("i"), F.col("__h").alias("h"))
    # equal SimHashes are one node from here on
    nodes = cut(rows.groupBy(*sims).agg(F.min(order).alias("__least")).withColumn("node", F.monotonically_increasing_id()))
    bits, tables, most = p.bits, p.tables, int(p.apart * BITS)
    depth = min(bits // 3, max(0, math.ceil(math.log2(max(1, nodes.count()) / p.cell))))

    def send(first: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes by table and cell. Of nodes with one fingerprint, whose variants are the same, those that are near a leader are paired with it (table -1) and not sent."""
        for s, ids in _held(batches):
            for t in range(first, min(tables, first + ROUND)):
                prints = fingerprint(s, t, bits)
                by = np.lexsort((ids, prints))
                cuts = np.flatnonzero(np.concatenate([[True], prints[by][1:] != prints[by][:-1], [True]]))
                to = lead(cuts, s[by], most)
                leads = to == np.arange(len(by))
                if not leads.all():
                    pairs = np.stack([ids[by[to[~leads]]], ids[by[~leads]]], axis=1)
                    yield _blobs(-1, np.full(len(pairs), ids[0] % 997), pairs)
                own = by[leads]
                at, cells = targets(prints[own], depth)
                sent = np.empty(len(at), _NODE)
                sent["id"], sent["s"] = ids[own[at]], s[own[at]]
                yield _blobs(t, cells, sent)
        tidy()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Verified pairs, from the rows of :func:`send` in the order of table and cell."""
        pairs = lambda x: pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])
        for (t, cell), data in _by_cell(batches):
            if t < 0:
                yield pairs(np.frombuffer(data, np.int64).reshape(-1, 2))
                continue
            there = np.frombuffer(data, _NODE)
            there = there[np.argsort(there["id"])]
            ids, s = there["id"], np.ascontiguousarray(there["s"])
            for offsets, at in buckets(fingerprint(s, t, bits), bits, depth, cell):
                to = at[lead(offsets, s[at], most)]
                apart = to != at
                # positions ascend with nodes, so a pair is one number
                both = np.unique(to[apart] * len(ids) + at[apart])
                yield pairs(np.stack([ids[both // len(ids)], ids[both % len(ids)]], axis=1))
        tidy()

    def met(first: int) -> DataFrame:
        sent = nodes.select(*sims, "node").mapInArrow(partial(send, first), "table int, cell long, data binary")
        # a task holds one cell at a time
        return cut(sent.repartition("table", "cell").sortWithinPartitions("table", "cell").mapInArrow(meet, "a long, b long").distinct())

    rounds = []
    for first in range(0, tables, ROUND):
        rounds.append(met(first))
        gc.collect()  # shuffle files stay until the driver collects what refers to them
        docs.sparkSession.sparkContext._jvm.System.gc()
    pairs = cut(reduce(DataFrame.unionAll, rounds).distinct())
    # what is linked through others only is parted again: a component's members go to leaders, smallest doc_id first
    linked = components(pairs)
    linked = linked.unionAll(linked.select(F.col("__to").alias("node"), "__to").distinct()).join(nodes, "node").select("__to", "__least.i", "__least.h", "node", *sims)
    linked = parted(cut(linked), most, p.group)
    named = nodes.select("node", *sims).join(small(linked, 40), "node", "left").withColumn("__to", F.coalesce("__to", "node"))
    full = rows.join(named, sims).select("__id", "__h", "__n", "__to")
    first = full.groupBy("__to").agg(F.min(order).alias("__least"), F.sum("__n").alias("__rows")).where("__rows > 1")
    return cut(full.join(first, "__to").select("__id", "__h", "__n", "__to", (order == F.col("__least")).alias("__first"), F.col("__least.i").alias("__keep")))


def _held(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """SimHashes and nodes of a task, many at a time."""
    held, n = [], 0
    for b in batches:
        held.append((np.stack([b.column(k).to_numpy().view(np.uint64) for k in range(WORDS)], axis=1), b.column(WORDS).to_numpy()))
        n += len(b)
        if n >= most:
            yield np.concatenate([s for s, _ in held]), np.concatenate([i for _, i in held])
            held, n = [], 0
    if n:
        yield np.concatenate([s for s, _ in held]), np.concatenate([i for _, i in held])


def _blobs(table: int, cells: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One row for each cell, with the bytes of its rows; cells ascend."""
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(cells)) if len(cells) else starts
    data = pa.array([rows[lo:hi].tobytes() for lo, hi in zip(starts, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), table, np.int32)), pa.array(cells[starts].astype(np.int64)), data], names=["table", "cell", "data"])


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bytes]]:
    """Joins the bytes of the rows of each table and cell, which follow each other."""
    at, held = None, []
    for b in batches:
        for t, cell, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if (t, cell) != at:
                if held:
                    yield at, b"".join(held)
                at, held = (t, cell), []
            held.append(data.as_py())
    if held:
        yield at, b"".join(held)


def _members(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of (i, h, node, SimHash): offsets, and the members' fields, in the order of i and h within a list."""
    lens, members = column.value_lengths().to_numpy(), column.flatten()
    i, h, ids = (members.field(k).to_numpy() for k in range(3))
    s = np.stack([members.field(k + 3).to_numpy().view(np.uint64) for k in range(WORDS)], axis=1)
    order = np.lexsort((h, i, np.repeat(np.arange(len(lens)), lens)))
    return np.concatenate([[0], np.cumsum(lens)]), i[order], h[order], ids[order], s[order]


def parted(linked: DataFrame, most: int, group: int, heads: int = 256) -> DataFrame:
    """(node, __to): members (__to, i, h, node, SimHash) of checkpointed components, each with the leader that it is near to.

    A component of up to ``group`` members is led in one row. Larger ones are led in rows of about that many: the leaders of all rows,
    the first ``heads`` of them, are led again, all members are held against those that remain, and
    members that are near none of them go on in the same way, until there are none.
    """
    sims = [f"__s{k}" for k in range(WORDS)]
    fields = F.struct("i", "h", "node", *sims)
    typed = "i long, h long, node long, " + _SIMS

    def lead_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, _, _, ids, s = _members(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[lead(offsets, s, most)])], names=["node", "__to"])

    def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, i, h, ids, s = _members(b.column(1))
            on = lead(offsets, s, most) == np.arange(len(ids))
            of = np.repeat(b.column(0).to_numpy(), np.diff(offsets))[on]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of, i[on], h[on], ids[on], *(s[on, k].view(np.int64) for k in range(WORDS)))], names=["__to", "i", "h", "node", *sims])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, _, _, ids, s = _members(b.column(0))
            starts, _, _, names, own = _members(b.column(1))
            to = np.full(len(ids), -1)
            for row in range(len(b)):
                mine = np.arange(offsets[row], offsets[row + 1])
                for head in range(starts[row], starts[row + 1]):
                    near = np.bitwise_count(s[mine] ^ own[head]).sum(1) <= most
                    to[mine[near]] = names[head]
                    mine = mine[~near]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(to, mask=to < 0)], names=["node", "__to"])

    size = cut(linked.groupBy("__to").agg(F.count("*").alias("__c")).where(F.col("__c") > group))
    one_row = lambda rows, *by: rows.groupBy(*by).agg(F.collect_list(fields).alias("members"))
    if size.isEmpty():
        return cut(one_row(linked, "__to").select("members").mapInArrow(lead_all, "node long, __to long"))
    done = one_row(linked.join(small(size, 24), "__to", "left_anti"), "__to").select("members").mapInArrow(lead_all, "node long, __to long")
    rest = linked.join(small(size, 24), "__to", "left_semi")
    while True:
        size = small(cut(rest.groupBy("__to").agg(F.ceil(F.count("*") / F.lit(group)).alias("__c"))), 24)
        lists = cut(one_row(rest.join(size, "__to").withColumn("__salt", F.pmod(F.xxhash64("node"), "__c")), "__to", "__salt"))
        local = lists.select("__to", "members").mapInArrow(leaders, "__to long, " + typed)
        first = local.withColumn("__n", F.row_number().over(Window.partitionBy("__to").orderBy("i", "h"))).where(F.col("__n") <= heads)
        led = one_row(first, "__to").mapInArrow(leaders, "__to long, " + typed)
        found = small(cut(one_row(led, "__to").withColumnRenamed("members", "heads")), 64 * heads)
        now = cut(lists.join(found, "__to").select("members", "heads").mapInArrow(assign, "node long, __to long"))
        done = done.unionAll(now.where("__to is not null"))
        rest = cut(rest.join(now.where("__to is null").select("node"), "node", "left_semi"))
        if rest.isEmpty():
            return cut(done)


def components(pairs: DataFrame) -> DataFrame:
    """(node, __to): connected components of checkpointed pairs (a, b), named by their smallest node.

    Large-star and small-star steps in turn, which end in few rounds whatever the components' shape.
    """
    edges = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("__to"))
        state = now


def near_duplicates(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """doc_id and keep_id for every doc_id that is a near copy (or copy) of another; keep_id is its group's smallest doc_id and is not returned itself.

    Texts are compared as sets of lower-cased words. Null, empty and wordless texts are in no group.
    Repeated rows count once. A null doc_id counts as the largest. Texts are read whole, other columns
    don't matter, an empty table gives an empty result.
    """
    got = groups(docs, p).where("not __first")
    keep = F.when(F.col("__keep") < 2**63 - 1, F.col("__keep"))
    return got.select(F.col("__id").alias("doc_id"), keep.alias("keep_id")).where("doc_id is distinct from keep_id").distinct()


def drop_near(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """``docs`` with one row of each group of :func:`near_duplicates`; rows in no group stay, as do null, empty and wordless texts.

    Of repeated rows in a group one stays. A null doc_id counts as the largest; columns of any name are kept as they are.
    """
    got = groups(docs, p)
    away = got.where("not __first").select("__id", "__h")
    again = cut(got.where("__first and __n > 1").select("__id", "__h"))
    same = lambda there: F.col("doc_id").eqNullSafe(there["__id"]) & (F.col("__th") == there["__h"])
    rows = packed(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), text_hash(F.coalesce("row.text", F.lit(""))).alias("__th"))
    off = small(cut(away.unionAll(again)), 40)
    kept = rows.join(off, same(off), "left_anti").select("row.*")
    if again.isEmpty():
        return kept
    again = small(again, 40)
    one = Window.partitionBy("doc_id", "__th").orderBy("row.text")
    return kept.unionAll(rows.join(again, same(again), "left_semi").withColumn("__k", F.row_number().over(one)).where("__k = 1").select("row.*"))
