"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Documents fall into shards by a seeded hash, and within a source and shard into blocks of equal tokens in
a seeded order. The blocks to keep in all, a share of the supply, are given to the sources one by one, each to the highest
quotient weight / (2 k + 1) of a source with k blocks so far that has another, so that a source that runs out leaves its
seats to the others; a source's quota is spread over the shards in the same way by the blocks they have. Only then are
blocks chosen: in a source and shard they stand in a ring in the seeded order, and the quota is taken from a seeded start on.
What is chosen is thus one or two runs of the seeded order, told by its ends, so each shard chooses on its own and
no text is shuffled. Quotas come from the divisor that gives the wanted sum, so blocks are never listed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegralType, StringType

from .shared import BROADCAST_BYTES, cut, lean, packed, small
from .token_counts import counter


@dataclass(frozen=True)
class MixParams:
    """weights: each source's target share of the tokens (others get none); None: in proportion to the square
    roots of the sources' tokens. share: of the blocks of all weighted sources so many are kept; blocks: how many instead.
    A shard has about shard_tokens tokens; what the driver holds is one row for each source and shard.
    vocabulary: a rank file by whose tokens to count; None: words."""

    weights: tuple[tuple[str, float], ...] | None = None
    share: float = 0.9
    blocks: int | None = None
    block_tokens: int = 2048
    shard_tokens: int = 1 << 28
    least_shards: int = 8
    seed: int = 29
    vocabulary: str | None = None

    def shards(self, tokens: int) -> int:
        return max(self.least_shards, -(-tokens // self.shard_tokens))


def apportion(weights: Sequence[float], caps: Sequence[int], seats: int) -> np.ndarray:
    """Sainte-Lague with capacities: ``seats`` go to the highest quotients w / (2 k + 1), k < cap; ties to the earlier.

    Finds the least quotient that is still served by bisection over its ranks, not by listing them.
    """
    w, caps = np.asarray(weights, float), np.where(np.asarray(weights, float) > 0, np.asarray(caps, np.int64), 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(w), np.int64)

    def count(q: float) -> np.ndarray:  # seats with a quotient of at least q
        k = np.minimum(np.floor((w / q + 1) / 2), caps).astype(np.int64)
        while True:  # put right what rounding did, comparing with the quotients themselves
            more = (k < caps) & (w / (2 * k + 1) >= q)
            less = (k > 0) & (w / np.maximum(2 * k - 1, 1) < q)
            if not (more | less).any():
                return k
            k = k + more - less

    hi, lo = w.max() * 2, (w[caps > 0] / (2 * caps[caps > 0] - 1)).min()
    got = count(lo)
    while got.sum() > seats:  # between two neighbouring floating-point numbers nothing is left to part
        mid = (lo + hi) / 2
        if mid <= lo or mid >= hi:
            break
        c = count(mid)
        if c.sum() >= seats:
            lo, got = mid, c
        else:
            hi = mid
    above = count(np.nextafter(lo, np.inf)) if got.sum() > seats else got
    left = seats - above.sum()
    if left > 0:
        for s in np.flatnonzero(got > above)[:left]:
            above[s] += 1
    return above


def quotas(counted: list[tuple], p: MixParams) -> list[tuple]:
    """From (source, shard, blocks, tokens) to (source, shard, blocks, start, quota).

    A source that has a weight and no tokens is kept whole and takes no seat.
    """
    by: dict = {}
    for source, shard, blocks, tokens in counted:
        by.setdefault(source, []).append((shard, blocks, tokens))
    names = sorted(by, key=lambda s: (s is None, s))
    tokens = {s: sum(t for _, _, t in by[s]) for s in names}
    given = dict(p.weights) if p.weights is not None else {s: math.sqrt(tokens[s] or 1) for s in names}
    weight = {s: float(given.get(s, 0.0)) for s in names}
    seated = [s for s in names if tokens[s] and weight[s] > 0]
    supply = [sum(b for _, b, _ in by[s]) for s in seated]
    total = p.blocks if p.blocks is not None else math.ceil(p.share * sum(supply) - 1e-9)
    won = dict(zip(seated, apportion([weight[s] for s in seated], supply, total)))
    out = []
    for source in names:
        own = sorted(by[source])
        blocks = [b for _, b, _ in own]
        if source in won:
            each = apportion(blocks, blocks, int(won[source]))
        else:
            each = blocks if weight[source] > 0 else [0] * len(own)
        out.extend((source, shard, b, _start(p.seed + 1, source, shard, b), int(q)) for (shard, b, _), q in zip(own, each))
    return out


def _start(seed: int, source, shard: int, blocks: int) -> int:
    return int(md5(f"{seed}|{'' if source is None else source}|{shard}".encode()).hexdigest()[:13], 16) % blocks


def _hash(seed: int, *cols: Column) -> Column:
    """A seeded hash that SQL elsewhere can compute too: the first 13 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])), 1, 13), 16, 10).cast("long")


def _order(seed: int, doc_id: Column) -> Column:
    """The seeded order of documents; a null doc_id is hashed as -1 and comes last among equals."""
    return F.struct(_hash(seed, F.coalesce(doc_id, F.lit(-1))).alias("h"), F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1)).alias("i"))


def _blocks(docs: DataFrame, p: MixParams) -> tuple[DataFrame, DataFrame, int]:
    """Every document's block, the quotas (s, k, number, start, quota), and the number of shards; the first one is checkpointed."""
    lean(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col("source"), counter(p.vocabulary)(F.col("text")).alias("n"))
    one = cut(rows.groupBy("doc_id", "source").agg(F.sum("n").alias("tokens")))  # repeated rows go together
    shards = p.shards(one.agg(F.sum("tokens")).first()[0] or 0)
    placed = one.withColumn("at", _order(p.seed, F.col("doc_id"))).withColumn("shard", F.col("at.h") % shards)
    own = Window.partitionBy("source", "shard")
    before = F.sum("tokens").over(own.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    summed = placed.withColumn("upto", before).withColumn("all", F.sum("tokens").over(own))
    number = F.greatest(F.lit(1), F.floor((2 * F.col("all") + p.block_tokens) / (2 * p.block_tokens))).cast("long")
    block = F.expr("cast(case when all = 0 then 0 else least(number - 1, upto * number div all) end as bigint)")
    blocks = cut(summed.withColumn("number", number).select("doc_id", "source", "shard", "tokens", "at", "number", block.alias("block")))
    counted = blocks.groupBy("source", "shard").agg(F.max("number"), F.sum("tokens")).collect()  # one row a source and shard
    quota = _local(docs.sparkSession, quotas([tuple(r) for r in counted], p), blocks.schema["source"].dataType)
    return blocks, F.broadcast(quota) if len(counted) * 128 <= BROADCAST_BYTES else quota, shards


def _local(spark: SparkSession, rows: list[tuple], kind: DataType) -> DataFrame:
    """(s, k, n, start, quota), handed over in Arrow: rows of tuples would pass through Python workers of another kind, which stay beside the others."""
    names = ("s", "k", "n", "start", "quota")
    schema = f"s {kind.simpleString()}, " + ", ".join(f"{c} long" for c in names[1:])
    if not isinstance(kind, (StringType, IntegralType)):
        return spark.createDataFrame(rows, schema)
    kinds = [to_arrow_type(kind), *[pa.int64()] * 4]
    return spark.createDataFrame(pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names), schema)


def _with_quota(rows: DataFrame, quota: DataFrame, how: str = "inner") -> DataFrame:
    return rows.join(quota, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("k")), how)


def mix_sources(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The documents that make up the mixture: doc_id, source, shard, block, tokens.

    A null source is a source of its own (named last), a null doc_id a document of its own in each source;
    rows with the same doc_id and source count as one document. Null and empty texts have no tokens and go
    with their block; a source with a weight of which no text has a token is kept whole. A document longer than a block
    belongs to the block in which it begins and fills those that follow. Equal quotients go to the source that
    comes first in order, equal hashes to the smaller doc_id. Other columns don't matter; an empty table
    gives an empty result.
    """
    blocks, quota, _ = _blocks(docs, p)
    return _with_quota(blocks, quota).where(F.pmod(F.col("block") - F.col("start"), "n") < F.col("quota")).select("doc_id", "source", "shard", "block", "tokens")


def keep_mixture(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The rows of ``docs`` that belong to the mixture of :func:`mix_sources`, with all their columns; nulls, ties and repeated rows as there.

    A run of blocks is a run of the seeded order of documents, so rows are held against the ends of the runs of their
    source and shard, which are few, and are not shuffled.
    """
    blocks, quota, shards = _blocks(docs, p)
    round_ = F.col("start") + F.col("quota") > F.col("n")
    end = F.col("start") + F.col("quota") - F.when(round_, F.col("n")).otherwise(0)
    runs = (
        _with_quota(blocks, quota)
        .groupBy("s", "k")
        .agg(
            F.min(F.when(F.col("block") >= F.col("start"), F.col("at"))).alias("first"), F.min(F.when(F.col("block") >= end, F.col("at"))).alias("next"),
            F.max(round_).alias("round"), F.max(F.col("quota") >= F.col("n")).alias("whole"),
        )
    )
    runs = small(cut(runs), 128)
    rows = packed(docs).withColumn("at", _order(p.seed, F.col("row.doc_id"))).withColumn("shard", F.col("at.h") % shards).withColumn("source", F.col("row.source"))
    after, before = F.coalesce(F.col("at") >= F.col("first"), F.lit(False)), F.coalesce(F.col("at") < F.col("next"), F.lit(True))
    inside = F.col("whole") | F.when(F.col("round"), after | before).otherwise(after & before)
    return rows.join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("k")) & inside, "left_semi").select("row.*")


#: DuckDB's way to the same rows: seats are listed and ranked.
MIX_SQL = """
with words as (
  select doc_id, source, trim(regexp_replace(coalesce(text, ''), '[ \\n\\t\\r]+', ' ', 'g')) as t from documents
), one as (
  select doc_id, source, cast(sum(case when length(t) = 0 then 0 else length(t) - length(replace(t, ' ', '')) + 1 end) as bigint) as tokens
  from words group by 1, 2
), placed as (
  select *, h % (select greatest(8, (sum(tokens)::bigint + 268435455) // 268435456) from one) as shard
  from (select *, cast('0x' || substr(md5('29|' || cast(coalesce(doc_id, -1) as varchar)), 1, 13) as bigint) as h from one)
), summed as (
  select doc_id, source, tokens, cast(shard as bigint) as shard,
    sum(tokens) over (partition by source, shard order by h, doc_id nulls last rows unbounded preceding) - tokens as upto,
    sum(tokens) over (partition by source, shard) as al
  from placed
), sized as (
  select *, cast(greatest(1, (2 * al + 2048) // 4096) as bigint) as n from summed
), blocks as (
  select doc_id, source, shard, tokens, n, cast(case when al = 0 then 0 else least(n - 1, upto * n // al) end as bigint) as block from sized
), each as (
  select source, shard, max(n) as n, sum(tokens) as tokens from blocks group by 1, 2
), weights as (
  select source, sum(n) as supply, sqrt(sum(tokens)) as w from each group by 1
), seats as (
  select source, w / (2 * k - 1) as quotient from weights, (select unnest(range(1, (select max(supply)::bigint from weights) + 1)) as k) where k <= supply and w > 0
), won as (
  select source, count(*) as quota from (select source, row_number() over (order by quotient desc, source nulls last) as place from seats)
  where place <= (select ceil(sum(supply) * 0.9 - 1e-9) from weights where w > 0) group by 1
), shard_seats as (
  select s.source, s.shard, s.n / (2 * k - 1) as quotient from each s, (select unnest(range(1, (select max(n) from each) + 1)) as k) where k <= s.n
), shard_won as (
  select source, shard, count(*) as quota from (
    select ss.source, shard, quota, row_number() over (partition by ss.source order by quotient desc, shard) as place
    from shard_seats ss join won on ss.source is not distinct from won.source)
  where place <= quota group by 1, 2
  union all select source, shard, n from each join weights using (source) where w = 0
)
select b.doc_id, b.source, b.shard, b.block, b.tokens
from blocks b join shard_won q on q.source is not distinct from b.source and q.shard = b.shard
where (b.block - cast('0x' || substr(md5('30|' || coalesce(b.source, '') || '|' || cast(b.shard as varchar)), 1, 13) as bigint) % b.n + b.n) % b.n < q.quota
"""
