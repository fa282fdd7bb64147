"""Training records: gates, negatives, records, splits, bundles, evidence and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def pair_gate(pairs: DataFrame) -> DataFrame:
    """reject_reason (null: accepted) of pairs (question, answer, context, positive_selected)."""
    answer = F.coalesce("answer", F.lit(""))
    reason = (
        F.when(~F.coalesce("positive_selected", F.lit(False)), "positive_not_selected").when(F.length(X.trim_all(F.coalesce("context", F.lit("")))) == 0, "empty_context")
        .when(F.length(X.trim_all(answer)) == 0, "empty_answer").when(X.has_answer_artefact(answer), "answer_style").when(X.is_refusal(answer), "refusal")
    )
    return pairs.withColumn("reject_reason", reason)


def message_records(turns: DataFrame) -> DataFrame:
    """id and messages (role, content, in order) from turns (conv_id, turn, role, text)."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")).select(F.concat(F.lit("sft_"), F.col("conv_id").cast("string")).alias("id"), "messages")


def hard_negatives(hits: DataFrame, positives: DataFrame, good: Column, most: int = 5) -> DataFrame:
    """The best good hits of each query of other documents than the positive one, one a document."""
    rows = hits.join(positives.select("query_id", F.col("doc_id").alias("positive")), "query_id").where((F.col("doc_id") != F.col("positive")) & good)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))).where("n = 1")
    return first.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("int")).where(F.col("k") <= most).select("query_id", "chunk_id", "doc_id", "k")


def easy_negatives(chunks: DataFrame, positives: DataFrame, good: Column, most: int = 5, seed: int = 7, probes: int | None = None) -> DataFrame:
    """For each query good chunks, one a document, from a place in a random-looking order of all chunks that depends on the query.

    Chunks have a place in one of ``probes`` slots by hash; a query takes the first of its slot, so no query meets all chunks.
    Without a number there are as many slots as give each 64 chunks, 64 at least, so what serves as a negative grows with the chunks.
    """
    if probes is None:
        probes = max(64, chunks.where(good).count() // 64)
    h = lambda c: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), c.cast("string"))), 1, 8), 16, 10).cast("long")
    rows = chunks.where(good).select("chunk_id", "doc_id", (h(F.col("chunk_id")) % probes).alias("slot"), h(F.col("chunk_id")).alias("h"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("slot", "doc_id").orderBy("h", "chunk_id"))).where("n = 1")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("slot").orderBy("h", "chunk_id"))).where(F.col("place") <= most + 1)
    q = positives.select("query_id", F.col("doc_id").alias("positive"), (h(F.col("query_id")) % probes).alias("slot"))
    met = q.join(rows, "slot").where("doc_id <> positive")
    return met.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("place")).cast("int")).where(F.col("k") <= most).select("query_id", "chunk_id", "doc_id", "k")


def leaks(text: Column, reference: Column, least: int = 8) -> Column:
    """Whether a negative contains the reference answer."""
    key = X.match_key(reference)
    return (F.length(key) >= least) & F.contains(X.match_key(text), key)


def dedupe_records(records: DataFrame) -> DataFrame:
    """The first record (seq) of each id and of each normalised question."""
    first = lambda rows, *by: rows.groupBy(*by).agg(F.min_by(F.struct(*records.columns), F.struct("seq", "id", "question")).alias("r")).select("r.*")
    return first(first(records, "id"), X.match_key(F.col("question")))


def grouped_split(records: DataFrame, group: str, ratio: float = 0.05, seed: int = 1337) -> DataFrame:
    """split ("val" or "train") of every record; a group is never in both. Groups come in the order of a seeded hash and fill val until it
    has its share. The running sum is over group sizes, summed by hash prefix first, so that it never sorts all groups in one task."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")), 256)
    sizes = records.groupBy(group).agg(F.count("*").alias("n")).withColumn("h", h).withColumn("p", F.substring("h", 1, 2))
    total = records.agg(F.greatest(F.lit(1), F.floor(F.count("*") * ratio)).alias("target"))
    prefix = sizes.groupBy("p").agg(F.sum("n").alias("m"))  # 256 rows at most
    prefix = prefix.withColumn("base", F.sum("m").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
    inner = F.sum("n").over(Window.partitionBy("p").orderBy("h", group).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = sizes.withColumn("before", inner).join(F.broadcast(prefix.select("p", "base")), "p").crossJoin(F.broadcast(total))
    named = placed.select(group, F.when(F.col("base") + F.col("before") < F.col("target"), "val").otherwise("train").alias("split"))
    return records.join(named, group)


def bundles(sft: DataFrame, pairs: DataFrame) -> DataFrame:
    """SFT records (id, messages) with their retrieval pair (origin_record_id, query, hard, easy: arrays of chunk ids; seq: the last wins)."""
    last = pairs.withColumn("n", F.row_number().over(Window.partitionBy("origin_record_id").orderBy(F.desc("seq")))).where("n = 1")
    answer = F.try_element_at(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
    tag = lambda c, t: F.transform(c, lambda x: F.struct(F.lit(t).alias("type"), x.alias("chunk_id")))
    return sft.join(last, F.col("id") == F.col("origin_record_id")).select("id", "query", answer.alias("answer"), F.concat(tag("hard", "hard"), tag("easy", "easy")).alias("negatives"))


def merge_evidence(rows: DataFrame, budget: int) -> DataFrame:
    """Evidence (record_id, url, search_rank, text) by rank, one a url, until a budget of characters is used up; the last one is cut."""
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("record_id", "url").orderBy("search_rank", "source"))).where("n = 1")
    w = Window.partitionBy("record_id").orderBy("search_rank", "url")
    placed = once.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < budget)
    return placed.select("record_id", "url", F.row_number().over(w).cast("int").alias("rank"), F.expr(f"substring(text, 1, cast({budget} - before as int))").alias("text"))


def evidence_gates(judged: DataFrame, primary: float = 0.82, shared: float = 0.72, against: float = 0.70) -> DataFrame:
    """Per record whether its judged evidence (source, tier, source_weight, relevance, supports, contradicts) verifies it."""
    score = F.col("relevance") * (0.85 + 0.15 * F.when(F.col("tier") == "primary", 1.0).otherwise(0.6) * F.col("source_weight"))
    rows = judged.withColumn("score", score)
    yes = F.col("supports")
    per = rows.groupBy("record_id").agg(
        F.round(F.coalesce(F.max(F.when(yes & (F.col("tier") == "primary"), F.col("score"))), F.lit(0.0)), 6).alias("primary_support"),
        F.count_distinct(F.when(yes & (F.col("score") >= shared), F.col("source"))).alias("supporting_sources"),
        F.round(F.coalesce(F.max(F.when(F.col("contradicts"), F.col("score"))), F.lit(0.0)), 6).alias("contradiction"),
    )
    return per.withColumn("verified", ((F.col("primary_support") >= primary) | (F.col("supporting_sources") >= 2)) & (F.col("contradiction") < against))


def apply_verdicts(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """metadata.answer_support_validated set by verdicts (id, verified); false where there is none."""
    joined = records.join(verdicts.select("id", "verified"), "id", "left")
    return joined.select("id", F.col("metadata").withField("answer_support_validated", F.coalesce("verified", F.lit(False))).alias("metadata"))


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed job has left to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
