"""From ranked hits to a context: features, reranking, duplicates, expansion, budget, claims, cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def hydrate(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with their chunk's and document's columns; the hits' order is in rank."""
    status = F.coalesce("status", F.lit(1)) == 1 if "status" in docs.columns else F.lit(True)
    return hits.join(chunks, "chunk_id").join(docs.where(status).drop("text"), "doc_id")


def feature_rerank(rows: DataFrame, profile: dict | None = None, named: Column | None = None) -> DataFrame:
    """rows: query_id, question, intent, entity, chunk_id, text, title, source, tier, weight, version_ord, baseline_ord, rrf_score,
    in_dense, dense_rank, in_bm25, bm25_rank. Adds rerank_score and rank. The entity is looked for in ``named``: the title up to the first bar, unless given.

    ``profile``: source_bonus (intent, source -> value), excluded (intent -> sources), title_boost, title_penalize, media, noisy.
    """
    p = {
        "source_bonus": {}, "excluded": {}, "title_boost": (), "title_boost_v": 0.15, "title_penalize": (), "recency": False,
        "media": (".gif", ".jpg", ".mp3", ".mp4", ".png", ".svg", ".webp"),
    } | (profile or {})
    q, t, title = X.tokenize(F.col("question")), F.col("text"), F.lower("title")
    zero = F.lit(0.0)
    by = lambda cond, yes, no=0.0: F.when(cond, F.lit(yes)).otherwise(F.lit(no))
    score = F.col("rrf_score") * F.coalesce("weight", F.lit(1.0)) + 0.02 * overlap(q, X.tokenize(t)) + 0.10 * overlap(q, X.tokenize(F.col("title")))
    score = score + F.when(F.col("tier") == "primary", 0.05).when(F.col("tier") == "supplementary", 0.02).otherwise(0.0)
    for (intent, source), value in sorted(p["source_bonus"].items()):
        score = score + by((F.col("intent") == intent) & (F.col("source") == source), float(value))
    for intent, sources in sorted(p["excluded"].items()):
        score = score - by((F.col("intent") == intent) & F.col("source").isin(*sources), 0.95)
    score = score + by(X.contains_any(title, p["title_boost"]), p["title_boost_v"]) - by(X.contains_any(title, p["title_penalize"]), 0.15)
    near = lambda c, a, b: F.when(F.col(c) <= 5, a).when(F.col(c) <= 15, b).otherwise(0.0)
    score = score + by(F.col("in_dense") & F.col("in_bm25"), 0.08) + by(F.col("in_bm25"), 0.05) + near("bm25_rank", 0.07, 0.04) + by(F.col("in_dense"), 0.03) + near("dense_rank", 0.05, 0.03)
    media = zero
    for m in p["media"]:
        media = media + (F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))) / len(m)
    marks = F.length(t) - F.length(F.regexp_replace(t, r"[\[\]%?=&/:.#_+]", ""))
    bare = F.length(X.trim_all(t))
    score = score - by(media > 3, 0.25) - by((bare > 50) & (marks > 0.30 * F.length(t)), 0.15) - by(bare < 100, 0.10)
    explicit, d = F.col("recent"), F.col("baseline_ord") - F.col("version_ord")
    known = F.col("baseline_ord").isNotNull() & F.col("version_ord").isNotNull() & (explicit | F.col("intent").isin("build", "mechanic", "version"))
    two = lambda a, b: F.when(explicit, F.lit(a)).otherwise(F.lit(b))
    recency = (
        F.when(~known, F.when(explicit & F.col("baseline_ord").isNotNull(), -0.04).otherwise(0.0)).when(d == 0, two(0.35, 0.12)).when(d < 0, -0.45)
        .when(d == 1, two(0.08, 0.04)).when(d <= 3, two(0.03, 0.01)).otherwise(-F.when(explicit, F.least(F.lit(0.30), 0.04 * d)).otherwise(F.least(F.lit(0.12), 0.02 * d)))
    )
    key, own = X.title_key(F.col("entity")), X.title_key(X.primary_title(F.col("title")) if named is None else named)
    entity = F.when(F.col("entity").isNull() | (key == ""), 0.0).when(own == key, 1.0).when(F.startswith(own, F.concat(key, F.lit(" "))), 0.10).when(F.contains(own, key), 0.05).otherwise(0.0)
    out = rows.withColumn("rerank_score", F.round(score + recency + entity, 10))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "chunk_id")
    return out.withColumn("rank", F.row_number().over(w).cast("int"))


def ltr_features(rows: DataFrame) -> DataFrame:
    """Features for learning to rank, one column each."""
    rr = lambda c: F.coalesce(1 / (60 + F.col(c)), F.lit(0.0))
    q = X.ltr_terms(F.col("question"))
    share = lambda c: F.when(F.size(q) > 0, overlap(q, X.ltr_terms(F.col(c))) / F.size(q)).otherwise(0.0)
    r = lambda c, n: F.round(c, 6).alias(n)
    return rows.select(
        "query_id", "chunk_id", r(F.col("rrf_score"), "f_rrf"), r(F.coalesce("dense_score", F.lit(0.0)), "f_dense"), r(F.coalesce("bm25_score", F.lit(0.0)), "f_bm25"),
        r(rr("dense_rank"), "f_dense_rr"), r(rr("bm25_rank"), "f_bm25_rr"), F.col("in_dense").cast("int").alias("f_in_dense"), F.col("in_bm25").cast("int").alias("f_in_bm25"),
        r(share("text"), "f_text_overlap"), r(share("title"), "f_title_overlap"), (X.title_key(F.col("title")) == X.title_key(F.col("question"))).cast("int").alias("f_exact_title"),
        r(F.coalesce("weight", F.lit(1.0)), "f_weight"), r(F.log1p(F.length("text")), "f_log_len"),
    )


def rescore_top(rows: DataFrame, score: Column, top: int) -> DataFrame:
    """The first ``top`` rows of each query by another score, the rest after them as they were."""
    rows = rows.withColumn("pair_score", F.when(F.col("rank") <= top, F.round(score, 6)))
    w = Window.partitionBy("query_id").orderBy((F.col("rank") > top).cast("int"), F.desc_nulls_last("pair_score"), "rank")
    return rows.withColumn("rank", F.row_number().over(w).cast("int"))


def most_per_doc(rows: DataFrame, most: int | Column) -> DataFrame:
    """At most so many rows of a document (of a source and title where there is none), the best ones."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws("|", "source", F.lower(F.trim("title"))))
    w = Window.partitionBy("query_id", key).orderBy("rank")
    kept = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("int"))


def entity_first(rows: DataFrame, named: Column | None = None) -> DataFrame:
    """Exact titles, then texts that name the entity, then related titles, then the rest; each in the order it had.
    Titles are compared up to the first bar, unless ``named`` is given."""
    key, title = X.title_key(F.col("entity")), X.title_key(X.primary_title(F.col("title")) if named is None else named)
    kind = (
        F.when(F.col("entity").isNull(), 0).when(title == key, 0).when(F.contains(title, key), 2)
        .when(F.contains(X.title_key(F.substring("text", 1, 3000)), key), 1).otherwise(3)
    )
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(kind, "rank")).cast("int"))


def _first_seen(rows: DataFrame, order: list, cap: int) -> DataFrame:
    """query_id, chunk_id by their first place in an order, capped and ranked."""
    once = rows.groupBy("query_id", "chunk_id").agg(F.min(F.struct(*order)).alias("o"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "chunk_id")).cast("int")).where(F.col("rank") <= cap).select("query_id", "chunk_id", "rank")


def parent_expand(seeds: DataFrame, chunks: DataFrame, children: int, max_parents: int, cap: int) -> DataFrame:
    """All chunks of the first parents that seeds (query_id, chunk_id, rank) fall into, parent by parent."""
    parent = (F.floor(F.col("chunk_id") / 1_000_000) * 1_000_000 + F.floor((F.col("chunk_id") % 1_000_000) / children)).cast("long")
    first = seeds.groupBy("query_id", parent.alias("parent_id")).agg(F.min("rank").alias("seen"))
    first = first.withColumn("p", F.row_number().over(Window.partitionBy("query_id").orderBy("seen"))).where(F.col("p") <= max_parents)
    return _first_seen(first.join(chunks.select("chunk_id", parent.alias("parent_id")), "parent_id"), ["p", "chunk_id"], cap)


def window_expand(seeds: DataFrame, chunks: DataFrame, before: int, after: int, cap: int) -> DataFrame:
    """Neighbouring chunks of the seeds within the same document, seed by seed. Chunk ids follow each other in a document, so neighbours are found by equality."""
    near = seeds.select("query_id", "rank", F.col("chunk_id").alias("seed"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("d"))
    near = near.select("query_id", "rank", (F.col("seed") + F.col("d")).alias("chunk_id"), "seed").where("floor(chunk_id / 1000000) = floor(seed / 1000000)")
    return _first_seen(near.join(chunks.select("chunk_id"), "chunk_id"), ["rank", "chunk_id"], cap)


def merge_keeping_seeds(seeds: DataFrame, extra: DataFrame, max_total: int, max_per_doc: int) -> DataFrame:
    """Seeds first, then extras, at most so many a document (seeds count, but always stay) and in all."""
    doc = F.floor(F.col("chunk_id") / 1_000_000)
    s = seeds.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    per = s.groupBy("query_id", doc.alias("doc")).agg(F.count("*").alias("n"))
    total = s.groupBy("query_id").agg(F.count("*").alias("seeds"))
    e = extra.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank")).join(s.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    e = e.withColumn("doc", doc).join(per, ["query_id", "doc"], "left").withColumn("k", F.row_number().over(Window.partitionBy("query_id", "doc").orderBy("rank")))
    e = e.where(F.coalesce("n", F.lit(0)) + F.col("k") <= max_per_doc).join(total, "query_id", "left").withColumn("g", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    e = e.where(F.col("g") <= F.greatest(F.lit(max_total), F.coalesce("seeds", F.lit(0))) - F.coalesce("seeds", F.lit(0)))
    both = s.select("query_id", "chunk_id", F.lit(0).alias("p"), "rank").unionByName(e.select("query_id", "chunk_id", F.lit(1).alias("p"), "rank"))
    return both.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("p", "rank")).cast("int").alias("rank"))


def trim_to_budget(rows: DataFrame, max_chunks: int, max_chars: int, per_chunk: int, least: int = 200) -> DataFrame:
    """Texts in order until the budget leaves less than ``least`` characters, the last one cut."""
    t = X.trim_all(F.col("text"))
    rows = rows.where(F.length(t) > 0).withColumn("text", t).withColumn("u", F.least(F.length("text"), F.lit(per_chunk)))
    w = Window.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("before", F.coalesce(F.sum("u").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.row_number().over(w))
    left = max_chars - F.col("before")
    rows = rows.where((left >= least) & (F.col("n") <= max_chunks))
    return rows.withColumn("text", F.expr(f"substring(text, 1, cast(least(u, {max_chars} - before) as int))")).withColumn("rank", F.col("n").cast("int")).drop("u", "before", "n")


def build_context(rows: DataFrame) -> DataFrame:
    """One text a query: every chunk under a line that names it, parted by rules."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit(" ("), "source", F.lit(")\n"), "text")
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"]), "\n---\n").alias("context"))


def unique_docs(rows: DataFrame) -> DataFrame:
    """Each query's documents in the order they first appear."""
    first = rows.groupBy("query_id", "doc_id").agg(F.min("rank").alias("r"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("r")).cast("int").alias("rank"))


def claim_check(claims: DataFrame, least: float = 0.85, fail_closed: bool = True) -> DataFrame:
    """claims (answer_id, claim, verdict, confidence) to passed and the number of unsafe claims; an answer without claims passes unless it fails closed."""
    unsafe = (F.coalesce("verdict", F.lit("")) != "supported") | (F.coalesce("confidence", F.lit(0.0)) < least)
    per = claims.groupBy("answer_id").agg(F.count("claim").alias("n_claims"), F.sum((unsafe & F.col("claim").isNotNull()).cast("long")).alias("n_unsafe"))
    return per.withColumn("passed", (F.col("n_unsafe") == 0) & ((F.col("n_claims") > 0) | F.lit(not fail_closed)))


def cache_rows(accesses: DataFrame, now: Column, ttl: float, most: int) -> DataFrame:
    """The cache after accesses (cache_key, at): the last write of each key that hasn't expired, at most so many, the newest."""
    rows = accesses.groupBy("cache_key").agg(F.max("at").alias("created_at")).withColumn("expires_at", F.col("created_at") + F.lit(ttl)).where(F.col("expires_at") >= now)
    w = Window.orderBy(F.desc("created_at"), "cache_key")
    return rows.orderBy(F.desc("created_at"), "cache_key").limit(most).withColumn("place", F.row_number().over(w).cast("int"))
