"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Vectors fall into cells around pivots; a cell is split by hash into shards of bounded size, however many vectors it holds, and a
tree is built over each shard. Queries are the vectors whose identifiers are divisible by ``every``. They visit cells in the order of
their upper bounds, in rounds that grow: after each round a query's kth score is that of all it has found so far, and
only cells whose bound reaches it are visited in the next. In a shard a query opens the node with the highest
bound among those it has not opened, root first, so whole branches below its kth score are never entered; what it finds raises the score.

A node's bound is the lesser of two: that of its ball (q.c + |q| r) and that of the cone around its center that holds
its vectors (|q| times their largest norm times the cosine of the least angle left).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, small

SLACK = 2e-6  # scores are compared after rounding to 6 digits; bounds must not cut off what rounds up


@dataclass(frozen=True)
class TopKParams:
    """every: vectors whose identifier it divides are queries. shard_rows: vectors of a tree; block_rows: queries that meet a tree in one task.
    cells bounds the pivots, which every task holds. A round takes growth times as many cells as all before it."""

    k: int = 10
    every: int = 100
    shard_rows: int = 8192
    cells: int = 4096
    leaf_rows: int = 128
    block_rows: int = 4096
    growth: int = 4


def bounds(q: np.ndarray, centers: np.ndarray, radii: np.ndarray, cosines: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries with what lies in each node: within ``radii`` of its center, at an angle to
    it whose cosine is at least ``cosines``, and of a norm between ``least`` and ``most``."""
    dot = q @ centers.T
    size = np.sqrt((q * q).sum(1))[:, None]
    ball = dot + size * radii
    norm = size * np.sqrt((centers * centers).sum(1))
    cos = np.clip(np.divide(dot, norm, out=np.ones_like(dot), where=norm > 1e-9), -1, 1)
    near = cos * cosines + np.sqrt(1 - cos * cos) * np.sqrt(1 - cosines * cosines)  # cosine of the angle to the cone's edge
    near = np.where(cos >= cosines, 1.0, near)  # inside the cone
    cone = size * np.where(near >= 0, near * most, near * least)
    return np.minimum(ball, np.where(norm > 1e-9, cone, np.inf)) + 1e-9


def spread(own: np.ndarray, center: np.ndarray) -> tuple[float, float, float, float]:
    """Of vectors around a center: radius, least cosine to it, least and largest norm; each a little to the safe side."""
    norms = np.sqrt((own * own).sum(1))
    radius = np.sqrt(((own - center) ** 2).sum(1).max())
    size = np.sqrt(center @ center)
    if size < 1e-9 or norms.min() < 1e-9:
        cosine = -1.0
    else:
        cosine = max(-1.0, ((own @ center) / norms / size).min() - 1e-9)
    return radius * (1 + 1e-9) + 1e-12, cosine, norms.min() * (1 - 1e-9), norms.max() * (1 + 1e-9)


class BallTree:
    """A median-split tree over vectors. Node n has left[n] and right[n] below it, or, where these are -1, the rows[n] of a leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int):
        self.ids, self.vectors = ids, vectors
        self.left: list[int] = []
        self.right: list[int] = []
        self.rows: list[np.ndarray | None] = []
        centers, stats = [], []
        stack: list[tuple[np.ndarray, int, bool]] = [(np.arange(len(ids)), -1, False)]
        while stack:
            at, up, is_right = stack.pop()
            own, node = vectors[at], len(self.rows)
            if up >= 0:
                (self.right if is_right else self.left)[up] = node
            centers.append(own.mean(0))
            stats.append(spread(own, centers[-1]))
            self.left.append(-1)
            self.right.append(-1)
            if len(at) <= leaf_rows or (own == own[0]).all():
                self.rows.append(at)
                continue
            self.rows.append(None)
            along = own[:, int(np.argmax(own.max(0) - own.min(0)))]
            order = np.argsort(along, kind="stable")
            half = len(at) // 2
            stack += [(at[order[:half]], node, False), (at[order[half:]], node, True)]
        self.centers, self.stats = np.array(centers), np.array(stats)
        self.scored = 0  # pairs of a query and a vector that were compared

    def bound(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return bounds(q, self.centers[nodes], *self.stats[nodes].T)

    def search(self, qids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores (rounded, descending) and ids of the k best of every query that reach kth; -inf where there are fewer.

        In every step each query takes its open node of the highest bound; queries that took the same one go on together.
        """
        scores, found = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        kth = kth.copy()
        open_ = np.full((len(q), len(self.rows)), -np.inf)
        open_[:, 0] = self.bound(q, [0])[:, 0]
        live = np.arange(len(q))
        while len(live):
            node = open_[live].argmax(1)
            top = open_[live, node]
            go = (top >= kth[live] - SLACK) & (top > -np.inf)
            live, node, top = live[go], node[go], top[go]
            by = np.argsort(node, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(node[by])) + 1) if len(by) else ():
                rows, n = live[own], int(node[own[0]])
                open_[rows, n] = -np.inf
                if self.rows[n] is None:
                    below = [self.left[n], self.right[n]]
                    open_[np.ix_(rows, below)] = np.minimum(self.bound(q[rows], below), top[own][:, None])
                else:
                    self._scan(self.rows[n], rows, qids, q, kth, scores, found, k)
        return scores, found

    def _scan(self, at, rows, qids, q, kth, scores, found, k) -> None:
        s = np.round(q[rows] @ self.vectors[at].T, 6) + 0.0
        self.scored += s.size
        ids = self.ids[at]
        s[qids[rows][:, None] == ids[None, :]] = -np.inf
        better = (s >= kth[rows][:, None]) & (s > -np.inf)
        some = np.flatnonzero(better.any(1))
        if not len(some):
            return
        rows = rows[some]
        all_s = np.concatenate([scores[rows], np.where(better[some], s[some], -np.inf)], axis=1)
        all_i = np.concatenate([found[rows], np.broadcast_to(ids, (len(some), len(ids)))], axis=1)
        best = np.lexsort((all_i, -all_s), axis=1)[:, :k]
        scores[rows], found[rows] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_i, best, 1)
        kth[rows] = np.maximum(kth[rows], scores[rows][:, -1])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def clean(vectors: DataFrame) -> DataFrame:
    """__id and __v: one vector for each id, of finite numbers only, all of the most frequent length (the longer of two)."""
    v = F.col("embedding").cast("array<float>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("__id"), v.alias("__v")).where(
        "__id is not null and size(__v) > 0 and not exists(__v, x -> x is null or isnan(x) or abs(x) = cast('infinity' as float))"
    )
    one = cut(rows.groupBy("__id").agg(F.min("__v").alias("__v")))
    top = one.groupBy(F.size("__v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return one.where(F.size("__v") == (top["d"] if top else 0))


def top_k(vectors: DataFrame, p: TopKParams = TopKParams()) -> DataFrame:
    """vec_id, rank, neighbor_id, score: for every vector whose id ``every`` divides its k best others by inner product (rounded to 6 digits; ties: smaller id first).

    Rows with a null id are left out, as are vectors that are null, empty, hold a null, NaN or infinity, or differ in length from
    most. Of rows with the same id the least vector (in order) is taken. With fewer than k others there
    are fewer rows; an empty table gives an empty result. Equal vectors are each other's neighbours like
    any. Other columns don't matter.
    """
    spark = vectors.sparkSession
    rows = clean(vectors)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "vec_id long, rank long, neighbor_id long, score double")
    cells = max(1, min(p.cells, math.ceil(n / p.shard_rows)))
    picked = rows.orderBy(F.xxhash64("__id"), "__id").limit(cells).collect()  # any pivots give the same result
    pivots = np.array([r["__v"] for r in picked], np.float64).reshape(len(picked), -1)
    shared = spark.sparkContext.broadcast(pivots)

    @F.arrow_udf("struct<cell:bigint,far:double,cosine:double,norm:double>")
    def nearest(column: pa.Array) -> pa.Array:
        v, c = _matrix(column) if len(column) else np.zeros((0, shared.value.shape[1])), shared.value
        own = np.argmax(v @ c.T - (c * c).sum(1) / 2, axis=1)
        norm, size = np.sqrt((v * v).sum(1)), np.sqrt((c * c).sum(1))[own]
        both = norm * size
        cosine = np.divide((v * c[own]).sum(1), both, out=np.full(len(v), -1.0), where=both > 1e-9)
        return pa.StructArray.from_arrays([pa.array(x) for x in (own, np.sqrt(((v - c[own]) ** 2).sum(1)), cosine, norm)], ["cell", "far", "cosine", "norm"])

    placed = cut(rows.withColumn("x", nearest("__v")).select("__id", "__v", "x.*"))
    held = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far"), F.min("cosine"), F.min("norm"), F.max("norm")).orderBy("cell").collect()  # a row a cell
    names = np.array([h["cell"] for h in held], np.int64)
    parts = np.array([-(-h["n"] // p.shard_rows) for h in held], np.int64)
    stats = np.array([[h[2] * (1 + 1e-9) + 1e-12, max(-1.0, h[3] - 1e-9), h[4] * (1 - 1e-9), h[5] * (1 + 1e-9)] for h in held], np.float64)
    ball = spark.sparkContext.broadcast((names, parts, pivots[names], stats))

    @F.arrow_udf("bigint")
    def share(cell: pa.Array, h: pa.Array) -> pa.Array:
        names, parts, *_ = ball.value
        return pa.array(h.to_numpy() % parts[np.searchsorted(names, cell.to_numpy())])

    part = share("cell", F.xxhash64("__id", F.lit(3)))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        """A shard as one row of bytes, which is what the rounds shuffle."""
        group = group.sort_values("__id")
        v = np.stack(group["__v"].to_numpy()).astype(np.float32)
        return pd.DataFrame({"cell": group["cell"].iloc[:1], "part": group["part"].iloc[:1], "ids": [group["__id"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()]})

    shards = cut(placed.select("__id", "__v", "cell", part.alias("part")).groupBy("cell", "part").applyInPandas(grow, "cell long, part long, ids binary, vectors binary"))

    @F.arrow_udf("array<struct<cell:bigint,part:bigint>>")
    def visits(column: pa.Array, kth: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        """The shards of the cells of places first to last in the order of a query's bounds, as far as these reach its kth score."""
        names, parts, centers, stats = ball.value
        if not len(column):
            return pa.array([], pa.list_(pa.struct([("cell", pa.int64()), ("part", pa.int64())])))
        bound = bounds(_matrix(column), centers, *stats.T)
        lo, hi = first[0].as_py(), last[0].as_py()
        order = np.argsort(-bound, axis=1, kind="stable")[:, lo:hi]
        ok = np.take_along_axis(bound, order, 1) >= kth.to_numpy(zero_copy_only=False)[:, None] - SLACK
        out = [[{"cell": int(names[c]), "part": k} for c in o[y] for k in range(int(parts[c]))] for o, y in zip(order, ok)]
        return pa.array(out, pa.list_(pa.struct([("cell", pa.int64()), ("part", pa.int64())])))

    def meet(tree_rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(tree_rows):
            return pd.DataFrame({"vec_id": [], "neighbor_id": [], "score": []})
        ids = np.frombuffer(tree_rows["ids"].iloc[0], np.int64)
        v = np.frombuffer(tree_rows["vectors"].iloc[0], np.float32).reshape(len(ids), -1).astype(np.float64)
        tree, q = BallTree(ids, v, p.leaf_rows), np.stack(queries["__v"].to_numpy()).astype(np.float64)
        qids = queries["__id"].to_numpy()
        scores, found = tree.search(qids, q, queries["kth"].to_numpy(), p.k)
        ok = scores > -np.inf
        return pd.DataFrame({"vec_id": np.repeat(qids, ok.sum(1)), "neighbor_id": found[ok], "score": scores[ok]})

    best = Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor_id")
    queries = cut(placed.where(F.col("__id") % p.every == 0).select("__id", "__v"))
    hits, first, last = None, 0, 1
    while first < len(names):
        known = queries.withColumn("kth", F.lit(float("-inf")))
        if hits is not None:
            kth = hits.where(F.col("rank") == p.k).select(F.col("vec_id").alias("__id"), F.col("score").alias("s"))
            known = queries.join(kth, "__id", "left").select("__id", "__v", F.coalesce("s", F.lit(float("-inf"))).alias("kth"))
        sent = known.select("__id", "__v", "kth", F.explode(visits("__v", "kth", F.lit(first), F.lit(last))).alias("to")).select("__id", "__v", "kth", "to.*")
        # a shard that many queries want is copied for blocks of them
        wanted = small(cut(sent.groupBy("cell", "part").agg(F.ceil(F.count("*") / F.lit(p.block_rows)).alias("blocks"))), 24)
        blocked = sent.join(wanted, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("__id", F.lit(1)), "blocks"))
        copies = shards.join(wanted, ["cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        more = copies.groupBy("cell", "part", "block").cogroup(blocked.groupBy("cell", "part", "block")).applyInPandas(meet, "vec_id long, neighbor_id long, score double")
        both = more if hits is None else more.unionByName(hits.drop("rank"))
        hits = cut(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k))
        first, last = last, min(len(names), last * (p.growth + 1))
    return hits.select("vec_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", F.round("score", 6).alias("score"))


TOPK_SQL = """
with v as (select vec_id, min(cast(embedding as double[])) as e from embeddings where vec_id is not null and len(embedding) > 0 group by 1),
w as (select * from v where len(e) = (select len(e) from v group by 1 order by count(*) desc, 1 desc limit 1)),
pairs as (
  select a.vec_id, b.vec_id as neighbor_id, round(list_dot_product(a.e, b.e), 6) as score
  from w a join w b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), ranked as (
  select *, row_number() over (partition by vec_id order by score desc, neighbor_id) as rank from pairs
)
select vec_id, rank, neighbor_id, score from ranked where rank <= 10
"""
