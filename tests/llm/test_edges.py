"""Defined results on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm.chat import chat_trees
from siltstone.llm.exact_dedup import drop_exact, exact_dedup
from siltstone.llm.mixing import keep_mixture, mix_sources
from siltstone.llm.packing import PackParams, pack
from siltstone.llm.quality import quality
from siltstone.llm.simhash import drop_near, near_duplicates
from siltstone.llm.token_counts import token_counts
from siltstone.llm.topk import TopKParams, top_k
from siltstone.llm.toxicity import drop_toxic, toxicity
from siltstone.llm.warc import page_records

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k}" for k in range(60_000))
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n ", None, "b", 3), (4, "the very same text here", "en", "b", 23), (5, "the very same text here", "en", "b", 23),
    (5, "the very same text here", "en", "b", 23), (None, "the very same text here", "en", None, 23), (6, LONG, "en", "a", len(LONG)), (7, LONG + " end", "en", "a", 1), (8, "", None, None, None), (9, "!!! ???", "en", "a", 7),
]
CLASHES = ("shard", "block", "bin", "key", "node", "keep_id", "score", "tokens", "h", "s", "k", "row", "__id", "__th", "__hi", "__n", "__text")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, DOCS)
    return rows.withColumns({c: F.lit("x") for c in CLASHES}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (6, 0, 1), (None, 1, 1), (9, None, None), (4, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))


def rows(df, *order):
    return sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)


def test_exact(docs):
    assert rows(exact_dedup(docs), "doc_id", "keep_id") == rows_of([(5, 4), (5, 4), (None, 4), (8, 2)])
    kept = drop_exact(docs)
    assert kept.columns == docs.columns and rows(kept, "doc_id") == rows_of([(1,), (2,), (3,), (4,), (6,), (7,), (9,)])


def rows_of(x):
    return sorted(x, key=repr)


def test_exact_null_id_alone(spark):
    got = exact_dedup(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string"))
    assert rows(got, "doc_id", "keep_id") == [(None, None)]


def test_near(docs):
    assert rows(near_duplicates(docs), "doc_id", "keep_id") == rows_of([(5, 4), (None, 4), (7, 6)])
    kept = drop_near(docs)
    assert kept.columns == docs.columns and rows(kept, "doc_id") == rows_of([(1,), (2,), (3,), (4,), (6,), (8,), (9,)])


def test_near_keeps_one_of_repeated_rows(spark):
    got = drop_near(spark.createDataFrame([(1, "some words to repeat"), (1, "some words to repeat"), (2, None), (2, None)], "doc_id long, text string"))
    assert rows(got, "doc_id") == [(1,), (2,), (2,)]


def test_toxicity(docs, labels):
    got = toxicity(docs, labels)
    assert got.columns == ["doc_id", "score", "toxic"] and got.count() == len(ROWS)
    flags = {(r["doc_id"], r["toxic"]) for r in got.collect()}
    assert {(1, False), (2, False), (3, False), (8, False), (9, False)} <= flags
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.where("not toxic").count()
    assert toxicity(docs, labels.limit(0)).where("toxic").isEmpty()


def test_quality(docs, labels):
    got = quality(docs, labels)
    assert got.count() == len(ROWS)
    flags = {r["doc_id"]: (r["score"], r["keep"]) for r in got.collect()}
    assert flags[1] == flags[2] == flags[3] == flags[8] == (0.0, False)
    assert quality(docs, labels.limit(0)).where("not keep").count() == 4


def test_mixing(docs):
    got = mix_sources(docs)
    assert got.columns == ["doc_id", "source", "shard", "block", "tokens"]
    assert got.select("doc_id", "source").distinct().count() == got.count()
    kept = keep_mixture(docs)
    assert kept.columns == docs.columns and kept.select("doc_id", "source").distinct().exceptAll(got.select("doc_id", "source")).isEmpty()


def test_packing(docs):
    got = pack(docs, PackParams(capacity=1000, vocabulary=None))
    per = {(r["doc_id"]): r["n"] for r in got.groupBy("doc_id").agg(F.sum("tokens").alias("n")).collect()}
    assert per == {3: None, 4: 5, 5: 10, None: 5, 6: 60_000, 7: 60_001, 9: 2} or per == {4: 5, 5: 10, None: 5, 6: 60_000, 7: 60_001, 9: 2}
    assert got.groupBy("shard", "bin").agg(F.sum("tokens").alias("n")).where("n > 1000").isEmpty()


def test_token_counts(docs):
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs).collect()}
    assert got[1] == got[2] == got[8] == 0 and got[3] > 0 and got[6] >= 60_000 and len(got) == 10


def test_empty(spark, docs, labels):
    none = docs.limit(0)
    for got in (exact_dedup(none), drop_exact(none), near_duplicates(none), drop_near(none), toxicity(none, labels), quality(none, labels), mix_sources(none), keep_mixture(none), pack(none), token_counts(none)):
        assert got.isEmpty()
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).isEmpty()
    assert chat_trees(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()
    assert page_records(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_top_k(spark):
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0]), (6, [1.0]), (7, []), (8, [None, 1.0])]
    got = top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0)), TopKParams(k=2, every=1))
    assert rows(got, "vec_id", "rank", "neighbor_id", "score") == [(1, 1, 2, 1.0), (1, 2, 5, 0.0), (2, 1, 1, 1.0), (2, 2, 5, 0.0), (5, 1, 1, 0.0), (5, 2, 2, 0.0)]


def test_chat(spark):
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 1, "assistant", "no"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (None, 0, "user", "x"), (4, None, None, None), (5, 0, "user", "")]
    got = chat_trees(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)).withColumn("tree", F.lit(1)))
    nodes = {(r["tree_id"], r["node"]): r for r in got.collect()}
    assert {k: r["conv_ids"] for k, r in nodes.items()} == {(1, 0): [], (1, 1): [1, 3], (1, 2): [2], (4, 0): [4], (5, 0): [5]}
    first, yes, no = (nodes[1, k] for k in range(3))
    assert [tuple(x) for x in no["attends"]] == [(0, len(first["tokens"]))] == [tuple(x) for x in yes["attends"]]
    assert no["start"] == len(first["tokens"]) + len(yes["tokens"]) and no["position_ids"][0] == len(first["tokens"]) and no["parent_node"] == 0


def test_warc(spark):
    data = [(1, "http://a/1", "<p>x</p>"), (2, None, None), (None, "http://a/\r\nWARC-Type: x", ""), (1, "http://a/1", "<p>x</p>"), (3, "u", "é" * 300_000)]
    got = page_records(spark.createDataFrame(data, "page_id long, url string, html string").withColumn("block", F.lit("x")))
    assert got.where("not digest_ok").isEmpty()
    assert rows(got.withColumn("html", F.substring("html", 1, 9)), "page_id", "url", "html", "length") == rows_of(
        [(1, "http://a/1", "<p>x</p>", 8), (1, "http://a/1", "<p>x</p>", 8), (2, None, None, 0), (None, "http://a/%0D%0AWARC-Type: x", "", 0), (3, "u", "é" * 9, 600_000)]
    )


def test_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).isEmpty()
        if n < 4:
            assert got.columns == docs.columns and got.dtypes == docs.dtypes
        got.write.parquet(f"{tmp_path}/{n}")
        assert np.isfinite(got.count())
