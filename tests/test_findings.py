"""Inputs that went wrong once."""

import difflib
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltstone.functions import questions as Q
from siltstone.operators import audit as A
from siltstone.plans import QUERIES
from siltstone.plans import search_queries as S
from siltstone.streaming import jobs as J


def test_sample_of_keys_of_any_size(spark):
    keys = [0, 1, 7_999_999_999, 8_000_000_000, 8_000_000_001, 8_562_000_000, 9_999_000_003, (1 << 62) + 5, (1 << 63) - 1]
    rows = spark.createDataFrame([(k,) for k in keys + [-k for k in keys]], "chunk_id long")
    lcg = lambda k: (abs(k * 1103515245 + 42) % 2147483647) * (1 if k * 1103515245 + 42 >= 0 else -1)  # noqa: E731 -- the sign of SQL's remainder
    got = rows.select("chunk_id", A.lcg_order("chunk_id", 42).alias("at")).collect()
    assert {r["chunk_id"]: r["at"] for r in got} == {k: lcg(k) for k in keys + [-k for k in keys]}
    assert [r["chunk_id"] for r in A.sample_by_lcg(rows, "chunk_id", 42, 5).collect()] == sorted(keys + [-k for k in keys], key=lambda k: (lcg(k), k))[:5]


TITLES = ["Alpha | of the north", "North | alpha", "Alpha", "alpha beta|x", "none"]


def candidates(spark):
    rows = [(1, k, "Alpha", "Alpha words", t, f"text {k}", k + 1) for k, t in enumerate(TITLES)]
    return spark.createDataFrame(rows, "query_id long, chunk_id long, entity string, question string, title string, text string, rank int")


@pytest.mark.parametrize("name", ["i1_feature_rerank", "i6_entity_seed_order"])
def test_whole_titles_are_compared_as_in_sql(spark, monkeypatch, name):
    """A bar in a title doesn't end it."""
    rows = candidates(spark).withColumns({
        "doc_id": F.col("chunk_id"), "source": F.lit("s"), "rrf_score": F.lit(0.0), "in_dense": F.lit(False), "in_bm25": F.lit(False), "dense_rank": F.lit(None).cast("int"),
        "bm25_rank": F.lit(None).cast("int"),
    })
    monkeypatch.setattr(S, "hydrated", lambda spark, d: rows.drop("entity"))
    got = {r["chunk_id"]: r for r in QUERIES[name](spark, None).collect()}
    if name == "i6_entity_seed_order":
        assert [got[k]["rank"] for k in range(5)] == [2, 3, 1, 4, 5]
    else:
        monkeypatch.setattr(S, "hydrated", lambda spark, d: rows.drop("entity").withColumn("title", F.regexp_replace("title", r"\|", " ")))
        bare = {r["chunk_id"]: r["rerank_score"] for r in QUERIES[name](spark, None).collect()}
        assert {k: r["rerank_score"] for k, r in got.items()} == bare


def test_changed_pages_in_parts(spark, tmp_path):
    """Offsets don't grow with the pages of a time, and texts are read by tasks, part by part, each once, also after a restart."""
    rows = [(k, None if k == 5 else f"text {k}") for k in range(1000)]
    folder = tmp_path / "pages.parquet"
    folder.mkdir()
    write = lambda name, own: pq.write_table(pa.table({"page_id": [r[0] for r in own], "html": [r[1] for r in own]}), folder / f"{name}.parquet", row_group_size=90)
    write("a", rows[:700])
    write("b", rows[700:])
    source = J.ChangedPages({"fetch": "siltstone.streaming.jobs:parquet_pages", "path": str(folder)})
    want = {(f"p{k}", t or "", f"2024-01-0{k % 3 + 1}") for k, t in rows}
    batch = source.reader(None)
    assert {r for p in batch.partitions() for b in batch.read(p) for r in zip(*b.to_pydict().values())} == want
    fetch = J.parquet_pages(source.options)
    assert {len(fetch("2024-01-02", 7)[0]), fetch("2024-01-02", 7)[1]} == {7, 666 - 7} and set(fetch("", 1 << 30)[0]) == want

    stream, got, sizes, times = source.streamReader(None), [], [], []
    stream.MOST, at = 200, stream.initialOffset()
    while (end := stream.latestOffset()) != at:
        new = [r for p in stream.partitions(at, end) for b in stream.read(p) for r in zip(*b.to_pydict().values())]
        got, at = got + new, end
        sizes.append(len(json.dumps(end)))
        times += [r[2] for r in new]
        assert len(new) <= 200
        if len(sizes) == 4:
            stream = source.streamReader(None)
            stream.MOST = 200
            stream.partitions(at, at)
    assert sorted(got) == sorted(want) and times == sorted(times) and max(sizes) < 100 and len(sizes) > 12
    write("c", [(2000, "late")])
    late = []
    while (end := stream.latestOffset()) != at:  # of a time that was read before, or not
        late, at = late + [r for p in stream.partitions(at, end) for b in stream.read(p) for r in b.to_pydict()["title"]], end
    assert late == ["p2000"]


def test_changed_pages_query_over_parts(spark, tmp_path):
    folder = tmp_path / "pages.parquet"
    spark.range(0, 3000).selectExpr("id as page_id", "'http://x/' || id as url", "repeat('a', cast(id % 7 as int)) as html").repartition(5).write.parquet(str(folder))
    got = QUERIES["a2_changed_pages"](spark, str(tmp_path))
    assert {(r["title"], r["n"], r["changed"]) for r in got.collect()} == {(f"p{k}", k % 7, f"2024-01-0{k % 3 + 1}") for k in range(3000)} and got.count() == 3000


def test_closest_titles_as_by_comparing_all():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abde1") for _ in range(rng.randint(1, 6)))
    titles = [" ".join(word() for _ in range(rng.randint(1, 25))) for _ in range(150)] + ["", "!!", "The Old Mill: history", "the old-mill", "Zürich", "x" * 300]
    entities = [" ".join(rng.choice(titles[:150]).split()[: rng.randint(1, 3)]) for _ in range(25)] + ["old mil", "", "??", "a", "x" * 250, "nothing like it"]
    ratios = {e: [(Q.similarity(e, t), t) for t in titles] for e in entities}
    for least in (0.84, 0.5):
        closest = Q.ClosestTitles(entities, least)
        for lo in range(0, len(titles), 40):
            closest.add(titles[lo : lo + 40])
        want = {}
        for e in entities:
            score, title = max(ratios[e])
            if score >= least:
                want[e] = (title, score)
        assert {e: (t, s) for e, t, s in closest.found()} == want and len(want) > 15


def test_runs_are_compared_once_and_few_of_them(monkeypatch):
    """However often a run is in the titles; runs that can't be better than the best so far aren't compared."""
    seen, real = [], difflib.SequenceMatcher
    monkeypatch.setattr(difflib, "SequenceMatcher", lambda junk, a, b: seen.append(b) or real(junk, a, b))
    closest = Q.ClosestTitles(["old mill"], 0.84)
    closest.add(["old mill"] + [f"{k} old mill on the hill, old mills {k}" for k in range(500)])
    closest.add([f"{k} old mills, old mil" for k in range(500)])
    assert closest.found() == [("old mill", "old mill", 1.0)]
    assert len(seen) == len(set(seen)) <= 3
