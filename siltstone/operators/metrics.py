"""Retrieval metrics over one row a query: the rank of its positive document at each stage, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_of(hits: DataFrame, positives: DataFrame) -> DataFrame:
    """query_id, rank of the positive document (query_id, doc_id) among hits (query_id, doc_id, rank), or null."""
    best = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return positives.join(best, ["query_id", "doc_id"], "left").select("query_id", "rank")


def recall(rank: Column, k: int) -> Column:
    return F.avg(F.when(rank <= k, 1.0).otherwise(0.0))


def mrr(rank: Column, k: int) -> Column:
    return F.avg(F.when(rank <= k, 1 / rank).otherwise(0.0))


def ndcg(rank: Column, k: int) -> Column:
    return F.avg(F.when(rank <= k, 1 / F.log2(rank + 1)).otherwise(0.0))


def rank_stats(rank: Column, prefix: str) -> list[Column]:
    p = lambda x: F.round(F.percentile(rank, F.lit(x)), 6)
    return [
        F.count(rank).alias(f"{prefix}_found"), F.count(F.when(rank.isNull(), 1)).alias(f"{prefix}_missing"), F.round(F.avg(rank), 6).alias(f"{prefix}_mean"),
        p(0.5).alias(f"{prefix}_median"), p(0.9).alias(f"{prefix}_p90"), p(0.95).alias(f"{prefix}_p95"),
    ]


def summary(records: DataFrame) -> DataFrame:
    """All metrics in one row, from candidate_rank, reranked_rank, context_rank and latency_ms."""
    r = lambda c, n: F.round(c, 6).alias(n)
    cand, rer, ctx = F.col("candidate_rank"), F.col("reranked_rank"), F.col("context_rank")
    out = [F.count("*").alias("queries")]
    out += [r(recall(cand, k), f"candidate_recall_{k}") for k in (10, 32, 100, 300, 950)]
    out += [r(recall(rer, k), f"selected_recall_{k}") for k in (1, 3, 5, 8, 10, 32)]
    out += [r(mrr(cand, 10), "candidate_mrr_10"), r(ndcg(cand, 10), "candidate_ndcg_10"), r(mrr(rer, 10), "selected_mrr_10"), r(ndcg(rer, 10), "selected_ndcg_10")]
    both = lambda a, b: F.avg(F.when(a.isNotNull(), F.when(b.isNotNull(), 1.0).otherwise(0.0)))
    out += [r(both(cand, rer), "rerank_survival"), r(both(rer, ctx), "context_survival")]
    out += [F.count(F.when(cand.isNotNull() & rer.isNull(), 1)).alias("lost_in_rerank"), F.count(F.when(rer.isNotNull() & ctx.isNull(), 1)).alias("lost_in_context")]
    for c, n in ((cand, "candidate"), (rer, "selected"), (ctx, "context")):
        out += rank_stats(c, n)
    out += [r(F.avg("latency_ms"), "latency_mean"), r(F.percentile("latency_ms", F.lit(0.5)), "latency_p50"), r(F.percentile("latency_ms", F.lit(0.95)), "latency_p95")]
    return records.agg(*out)
