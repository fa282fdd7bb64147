"""Entities and relations as tables: eligible chunks, extraction, upserts, pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.questions import marker_pattern

#: Groups of words that hint at relations; configuration.
MARKERS: dict[str, Sequence[str]] = {
    "family": ("brother", "daughter", "father", "mother", "sister", "son"), "location": ("city", "from", "in", "near"),
    "membership": ("joined", "leader of", "member", "of"), "time": ("after", "before", "when"),
}
ENTITY_TYPES = ("event", "group", "person", "place", "unknown")
RELATION_TYPES = ("LOCATED_IN", "MEMBER_OF", "PARENT_OF", "RELATED_TO")


def marker_hits(c: Column, groups: dict[str, Sequence[str]] = MARKERS) -> Column:
    found = [F.when(F.lower(c).rlike(marker_pattern(m)), F.lit(g)) for g, m in sorted(groups.items())]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


ANSWER = "entities array<struct<name:string,type:string,aliases:array<string>>>, relationships array<struct<source:string,target:string,type:string,confidence:double>>"


def parse_extraction(rows: DataFrame) -> DataFrame:
    """chunk_id, g (a struct of ANSWER) from a model's answers; what can't be parsed has no entities."""
    plain = F.regexp_extract(F.regexp_replace(X.strip_thinking(F.col("answer")), r"```(json)?", ""), r"(?s)\{.*\}", 0)
    return rows.select("chunk_id", F.from_json(plain, ANSWER).alias("g"))


def entities(parsed: DataFrame) -> DataFrame:
    """chunk_id, key, name, type: one row a chunk and key; the first name wins, and the first type that is known."""
    rows = parsed.select("chunk_id", F.posexplode("g.entities").alias("pos", "e")).select("chunk_id", "pos", F.trim("e.name").alias("name"), F.lower(F.trim("e.type")).alias("type"))
    kind = F.when(F.col("type").isin(*ENTITY_TYPES), F.col("type")).otherwise("unknown")
    rows = rows.withColumn("key", X.entity_key(F.col("name"))).withColumn("type", kind).where("key <> ''")
    known = F.min(F.when(F.col("type") != "unknown", F.struct("pos", "type")))["type"]
    return rows.groupBy("chunk_id", "key").agg(F.min(F.struct("pos", "name"))["name"].alias("name"), F.coalesce(known, F.lit("unknown")).alias("type"))


def relations(parsed: DataFrame, named: DataFrame) -> DataFrame:
    """chunk_id, source_key, target_key, type, confidence between entities of the chunk; no loops; unknown types become RELATED_TO; the surest of equals."""
    rows = parsed.select("chunk_id", F.explode("g.relationships").alias("r"))
    kind = F.upper(F.regexp_replace(F.trim("r.type"), r"[\s-]+", "_"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r.confidence", F.lit(0.5))))
    rows = rows.select(
        "chunk_id", X.entity_key(F.col("r.source")).alias("source_key"), X.entity_key(F.col("r.target")).alias("target_key"),
        F.when(kind.isin(*RELATION_TYPES), kind).otherwise("RELATED_TO").alias("type"), confidence.alias("confidence"),
    ).where("source_key <> target_key")
    for end in ("source_key", "target_key"):
        rows = rows.join(named.select("chunk_id", F.col("key").alias(end)), ["chunk_id", end], "left_semi")
    return rows.groupBy("chunk_id", "source_key", "target_key", "type").agg(F.max("confidence").alias("confidence"))


def replace_chunks(stored: DataFrame, fresh: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges of some chunks replaced by fresh ones."""
    return stored.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(fresh).distinct()


def state_diff(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """chunk_id and action by comparing (chunk_id, hash, signature): NEW, CHANGED, DELETED; equal ones are left out."""
    a, b = stored.alias("a"), wanted.alias("b")
    action = F.when(F.col("a.chunk_id").isNull(), "NEW").when(F.col("b.chunk_id").isNull(), "DELETED").otherwise("CHANGED")
    same = F.col("a.hash").eqNullSafe(F.col("b.hash")) & F.col("a.signature").eqNullSafe(F.col("b.signature"))
    return a.join(b, F.col("a.chunk_id") == F.col("b.chunk_id"), "full_outer").where(F.col("a.chunk_id").isNull() | F.col("b.chunk_id").isNull() | ~same).select(
        F.coalesce("a.chunk_id", "b.chunk_id").alias("chunk_id"), action.alias("action")
    )


def orphan_entities(nodes: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Keys of entities that no chunk mentions and no relation ends in."""
    ends = edges.select(F.col("source_key").alias("key")).unionAll(edges.select("target_key"))
    return nodes.select("key").join(mentions.select("key"), "key", "left_anti").join(ends, "key", "left_anti")


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """key, hops: entities within some hops of the seeds, whichever way relations point."""
    both = edges.select(F.col("source_key").alias("a"), F.col("target_key").alias("b")).unionAll(edges.select("target_key", "source_key")).distinct()
    seen = seeds.select("key").distinct().withColumn("hops", F.lit(0))
    front = seen
    for n in range(1, hops + 1):
        front = front.join(both, F.col("key") == F.col("a")).select(F.col("b").alias("key")).distinct().join(seen, "key", "left_anti").withColumn("hops", F.lit(n))
        seen = seen.unionByName(front)
    return seen


def best_mention(mentions: DataFrame) -> DataFrame:
    """The most frequent name of each key, the first in order among equals."""
    n = mentions.groupBy("key", "name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy(F.desc("n"), "name")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select("key", "name", "n")
