"""A crawl over landed pages: breadth first along links, by anti-joins against what was seen. Fetching itself is an adapter's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .html import extract_links


def link_edges(pages: DataFrame) -> DataFrame:
    """src, dst of links between normalised urls."""
    rows = pages.select(X.url_normalize(F.col("url")).alias("src"), F.explode(extract_links("html", "url")).alias("dst"))
    return rows.distinct()


def crawl(pages: DataFrame, seeds: DataFrame, allowed: Column | None = None, depth: int = 3) -> DataFrame:
    """url, depth of the pages that are reached from the seeds' urls; ``allowed`` is a condition on dst."""
    edges = link_edges(pages)
    if allowed is not None:
        edges = edges.where(allowed)
    seen = seeds.select(X.url_normalize(F.col("url")).alias("url")).distinct().withColumn("depth", F.lit(0)).checkpoint()
    front = seen
    for n in range(1, depth + 1):
        front = front.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(n)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
