"""Chat formatting: conversations that share initial turns become one tree, whose shared tokens are emitted once.

A turn's node is named by a hash of the whole path to it, so equal beginnings meet by grouping, whatever
conversations they come from. A tree is emitted depth first. A node carries the position ids that its tokens
have on their own path and the intervals of the emitted tokens that it may attend to besides its own: those of its ancestors.

Trees may have any size. Children come in the order of their smallest conversations, so each node belongs to the chain of nodes of
one conversation, which is emitted in one piece, and then the chains that leave it, deepest first. A chain's place is told
by the list of (depth, conversation) at which its path leaves others; nodes are sorted by it over ranges, and places and
starts are running sums over these ranges, whose totals are all the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, lean, small
from .token_counts import TokenParams, encoder


@dataclass(frozen=True)
class ChatParams:
    """listed: conversations that end in one node are listed in rows of about so many."""

    vocabulary: str = TokenParams().vocabulary
    listed: int = 4096


def template(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}<|end|>\n"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_STEPS = pa.schema([("conv", pa.int64()), ("at", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("said", pa.binary()), ("last", pa.bool_())])
_CHAINS = pa.schema([("conv", pa.int64()), ("tree_id", pa.int64()), ("path", pa.list_(pa.struct([("up", pa.int64()), ("conv", pa.int64())])))])
_PLACED = pa.schema([("key", pa.binary()), ("said", pa.binary()), ("tree_id", pa.int64()), ("node", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
_NODES = pa.schema([("key", pa.binary()), ("said", pa.binary()), ("tree_id", pa.int64()), ("node", pa.int64()), ("parent_node", pa.int64()), ("start", pa.int64()), ("position", pa.int64()), ("above", pa.list_(pa.int64()))])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names.get(f.type, 'array<struct<up:bigint,conv:bigint>>')}" for f in schema)


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, said) in order to steps, whose key is the hash of all that was said so far; a conversation is read turn by turn."""

    def steps() -> Iterator[tuple]:
        before = None
        for conv, said in _rows(batches):
            if before and before[0] == conv:
                yield (*before, False)
                at, parent = before[1] + 1, before[2]
            else:
                if before:
                    yield (*before, True)
                at, parent = 0, b""
            before = (conv, at, md5(parent + said).digest(), parent, said)
        if before:
            yield (*before, True)

    return _batches(steps(), _STEPS)


def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, at, first) in order, first being a node's smallest conversation, to the chains that a conversation owns."""

    def each() -> Iterator[tuple]:
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            path: list[dict] = []
            for _, at, first in rows:
                if not path or path[-1]["conv"] != first:
                    path.append({"up": -at, "conv": first})
            if path[-1]["conv"] == conv:
                yield conv, path[0]["conv"], path

    return _batches(each(), _CHAINS)


def ancestors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, at, own, key, said, tree_id, node, start, n) in order to the nodes that a conversation owns, with what is above them."""

    def each() -> Iterator[tuple]:
        for _, rows in groupby(_rows(batches), key=lambda r: r[0]):
            up, position, above = -1, 0, []
            for _, _, own, key, said, tree, node, start, n in rows:
                if own:
                    yield key, said, tree, node, up, start, position, list(above)
                if n:
                    if above and above[-1] == start:
                        above[-1] = start + n
                    else:
                        above += [start, start + n]
                up, position = node, position + n

    return _batches(each(), _NODES)


def _placed(nodes: DataFrame) -> DataFrame:
    """Adds node and start to nodes (tree_id, path, at, key, said, n): their places and first tokens in the depth-first order of their tree."""
    cols = ["tree_id", "n", "key", "said"]
    ordered = cut(nodes.repartitionByRange("tree_id", "path", "at").sortWithinPartitions("tree_id", "path", "at").select(*cols))
    sums = pa.schema([("range", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("nodes", pa.int64()), ("tokens", pa.int64()), ("own_nodes", pa.int64()), ("own_tokens", pa.int64())])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a range: first and last tree, nodes and tokens in all and of the last tree."""
        first = last = None
        nodes = tokens = own_nodes = own_tokens = 0
        for b in batches:
            if not len(b):
                continue
            tree, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            if first is None:
                first = int(tree[0])
            begun = int(np.searchsorted(tree, tree[-1]))
            if last != int(tree[-1]):
                last, own_nodes, own_tokens = int(tree[-1]), 0, 0
            own_nodes, own_tokens = own_nodes + len(tree) - begun, own_tokens + int(n[begun:].sum())
            nodes, tokens = nodes + len(tree), tokens + int(n.sum())
        if first is not None:
            row = (TaskContext.get().partitionId(), first, last, nodes, tokens, own_nodes, own_tokens)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], schema=sums)

    got = ordered.select("tree_id", "n").mapInArrow(total, ", ".join(f"{f.name} long" for f in sums)).orderBy("range").collect()  # one row a range
    carried: dict[int, tuple[int, int, int]] = {}  # by range: its first tree, and the nodes and tokens of that in the ranges before
    tree, n_nodes, n_tokens = None, 0, 0
    for r in got:
        if r["first"] != tree:
            n_nodes = n_tokens = 0
        carried[r["range"]] = (r["first"], n_nodes, n_tokens)
        goes_on = r["first"] == r["last"] and r["first"] == tree
        tree, n_nodes, n_tokens = r["last"], r["own_nodes"] + n_nodes * goes_on, r["own_tokens"] + n_tokens * goes_on
    shared = nodes.sparkSession.sparkContext.broadcast(carried)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value.get(TaskContext.get().partitionId())
        for b in batches:
            if not len(b):
                continue
            tree, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(tree))))
            before = np.cumsum(n) - n
            node, start = np.arange(len(tree)) - starts[of], before - before[starts][of]
            if held[0] == tree[0]:  # its tree began earlier
                node[of == 0] += held[1]
                start[of == 0] += held[2]
            held = (int(tree[-1]), int(node[-1]) + 1, int(start[-1] + n[-1]))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(0), pa.array(node), pa.array(start), b.column(1)], schema=_PLACED)

    return ordered.mapInArrow(place, _ddl(_PLACED))


def chat_trees(conversations: DataFrame, p: ChatParams = ChatParams()) -> DataFrame:
    """One row a node: tree_id (the tree's smallest conversation), node (its place in depth-first order), parent_node (-1: none),
    part (0), conv_ids (conversations that end here), role, tokens, start (of its tokens in the tree's emitted sequence), position_ids, attends
    (intervals [start, end) of emitted tokens of its ancestors, neighbours merged). Where more than ``listed`` conversations end in a node,
    further rows of it with the parts 1, 2 and so on list the others, without tokens.

    Rows with a null conv_id are left out; a null turn comes last, a null role or text counts as empty. Repeated rows
    count once; different rows of the same turn follow each other by role, then by a digest of the text. Conversations that are equal
    throughout end in the same node. Trees of any size are emitted in one sequence each. Other columns don't matter; an empty
    table gives an empty result. Long conversations and texts are kept whole.
    """
    lean(conversations.sparkSession)
    vocabulary = p.vocabulary

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        enc = encoder(vocabulary)
        return pa.array([enc.encode_ordinary(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # with the role's length before it, no other role and text are hashed alike
    said = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.coalesce("turn", F.lit(2**63 - 1)).alias("turn"), role.alias("role"), text.alias("text"), said.alias("said"))
    turns = rows.select("conv", "turn", "role", "said").distinct().repartition("conv").sortWithinPartitions("conv", "turn", "role", "said")
    steps = cut(turns.select("conv", "said").mapInArrow(walk, _ddl(_STEPS)))
    texts = rows.groupBy("said").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    filled = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    encoded = cut(texts.select("said", "role", encode(filled).alias("tokens")))
    nodes = steps.groupBy("key").agg(F.min("conv").alias("first"), F.first("said").alias("said"), F.first("at").alias("at"), F.count_if("last").alias("ends"))
    nodes = cut(nodes.join(encoded.select("said", F.size("tokens").cast("long").alias("n")), "said"))
    in_order = lambda df, *cols: df.repartition("conv").sortWithinPartitions("conv", "at").select("conv", "at", *cols)
    owners = in_order(steps.select("conv", "at", "key").join(nodes.select("key", "first"), "key"), "first").mapInArrow(chains, _ddl(_CHAINS))
    owners = cut(owners)
    placed = cut(_placed(nodes.join(owners.withColumnRenamed("conv", "first"), "first").select("tree_id", "path", "at", "key", "said", "n")))
    known = placed.join(nodes.select("key", "first"), "key")
    paths = steps.join(owners.select("conv"), "conv", "left_semi").select("conv", "at", "key").join(known, "key").withColumn("own", F.col("first") == F.col("conv"))
    made = in_order(paths, "own", "key", "said", "tree_id", "node", "start", "n").mapInArrow(ancestors, _ddl(_NODES))
    many = small(nodes.where(F.col("ends") > p.listed).select("key", F.ceil(F.col("ends") / p.listed).alias("parts")), 40)
    ends = steps.where("last").select("key", "conv").join(many, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("conv"), "parts"), F.lit(0)).cast("int"))
    ends = ends.groupBy("key", "part").agg(F.array_sort(F.collect_list("conv")).alias("conv_ids"))
    pair = lambda i: F.struct(F.get("above", i * 2).alias("start"), F.get("above", i * 2 + 1).alias("end"))
    count = F.floor(F.size("above") / 2).cast("int")
    last = F.col("position") + F.size("tokens") - 1
    part = F.coalesce("part", F.lit(0))
    none, no_pair = F.array().cast("array<int>"), F.array().cast("array<struct<start:bigint,end:bigint>>")
    # a node has a row of part 0 of its own even where all its conversations fell to other parts
    listed = nodes.select("key", F.lit(0).alias("part")).join(ends, ["key", "part"], "left").unionByName(ends.where("part > 0"))
    return (
        made.join(encoded, "said")
        .join(listed, "key")
        .select(
            "tree_id", "node", "parent_node", part.alias("part"), F.coalesce("conv_ids", F.array().cast("array<long>")).alias("conv_ids"), "role",
            F.when(part == 0, F.col("tokens")).otherwise(none).alias("tokens"), "start",
            F.when((part == 0) & (F.size("tokens") > 0), F.sequence("position", last)).otherwise(F.array().cast("array<long>")).alias("position_ids"),
            F.when((part == 0) & (count > 0), F.transform(F.sequence(F.lit(0), count - 1), pair)).otherwise(no_pair).alias("attends"),
        )
    )
