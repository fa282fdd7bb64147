"""Small golden cases, and Python twins of the operators whose order matters."""

import random

import pytest
from compare import DIR
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import questions as Q
from siltstone.functions import text as X
from siltstone.operators import context as C
from siltstone.operators import indexes as I
from siltstone.operators import ingest as N
from siltstone.operators import metrics as E
from siltstone.operators import retrieval as R
from siltstone.operators.chunking import chunk_documents, parents, spans, sync
from siltstone.operators.dataset import grouped_split
from siltstone.plans import QUERIES


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first()["v"]


def test_chunk_spans():
    text = "Alpha beta gamma. Delta epsilon zeta! Eta theta iota kappa? Lambda mu."
    assert [text[i:j].strip() for i, j in spans(text, 40, 6)] == ["Alpha beta gamma. Delta epsilon zeta!", "zeta! Eta theta iota kappa? Lambda mu."]
    assert spans("x" * 25, 10, 3) == [(0, 10), (7, 17), (14, 24), (21, 25)]
    assert spans("", 10, 3) == []
    with pytest.raises(ValueError):
        spans("a. " * 50, 10, 9)


def test_chunks_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "word"), (5, "y" * 2000)], "doc_id long, text string")
    got = chunk_documents(rows).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {4: 1, 5: 5}


def test_deny_keeps_indexes(spark):
    rows = spark.createDataFrame([(1, "a" * 500 + "b" * 500 + "c" * 500)], "doc_id long, text string")
    got = chunk_documents(rows, 500, 0, ~F.contains("text", F.lit("b"))).select("chunk_index").collect()
    assert [r[0] for r in got] == [0, 2]


@pytest.mark.parametrize(
    "question, want",
    [
        ("What is Alder's signature weapon?", '"alder signature weapon" OR "alder" OR "signature" OR "weapon"'),
        ("who are you", ""),
        ("The single word is amber", '"single word amber" OR "single" OR "word" OR "amber"'),
    ],
)
def test_lexical_query(spark, question, want):
    assert one(spark, X.lexical_query(F.col("q")), q=question) == want


def test_version_signal(spark):
    v = X.version_signal(F.col("t"), F.col("b"), F.lit(False), {"moon two": 702})
    assert tuple(one(spark, v, t="Patch 4.8 notes", b="")) == ("4.8", 408)
    assert one(spark, v, t="3.14 is pi", b="")["ord"] is None
    assert one(spark, v, t="none", b="x" * 900 + " version 5.1 " + " v5.1")["ord"] == 501
    assert one(spark, v, t="none", b="x" * 900 + " version 5.1 v5.2")["ord"] is None
    assert tuple(one(spark, v, t="The Moon Two update", b="")) == ("moon two", 702)


@pytest.mark.parametrize(
    "question, intent",
    [
        ("What is the latest version?", "version"), ("Who is Ada?", "biography"), ("Where is the mill?", "location"), ("What is Ada's best build?", "build"),
        ("damage value of her skill at level 9", "mechanic"), ("What is obsidian?", "lookup"), ("the old legend", "lore"), ("hello there", "general"),
    ],
)
def test_intent(spark, question, intent):
    assert one(spark, Q.detect_intent(F.col("q")), q=question) == intent


def test_markers_are_words(spark):
    assert not one(spark, Q.has_marker(F.col("q"), ("map",)), q="a maple tree") and one(spark, Q.has_marker(F.col("q"), ("map",)), q="the map.")


def test_similarity():
    assert Q.similarity("Alder", "alder") == 1 and 0.84 < Q.similarity("hawthorm", "Hawthorn | Wiki") < 1 and Q.similarity("a", "") == 0


def test_html():
    from siltstone.sources.html import links, markdown

    page = '<body><nav>no</nav><main><h2>A &amp; B</h2><p>one <b>two</b><p>three<ul><li>x<li>y</ul><script>var a="</p>"</script></main><footer>z</footer></body>'
    assert markdown(page) == "## A & B\n\none **two**\n\nthree\n\n* x\n* y"
    assert links('<a href="/b#t">x</a><a href=mailto:q>y</a><A HREF=\'c\'>z</a>', "http://h/a/") == ["http://h/b", "http://h/a/c"]


def test_rrf(spark):
    hits = [(1, "dense", 10, 1), (1, "dense", 11, 2), (1, "dense", 12, 3), (1, "bm25", 12, 1), (1, "bm25", 10, 2)]
    rows = spark.createDataFrame([(q, c, k, 1.0, r) for q, c, k, r in hits], "query_id long, channel string, chunk_id long, score double, rank int")
    got = {r["chunk_id"]: r["rrf_score"] for r in R.fuse(rows, {"dense": 1.0, "bm25": 0.5}).collect()}
    assert got == pytest.approx({10: 0.244580, 12: 0.240697, 11: 0.161290}, abs=1e-6)
    again = {r["chunk_id"]: r["rrf_score"] for r in R.fuse(rows.orderBy(F.desc("rank")), {"bm25": 0.5, "dense": 1.0}).collect()}
    assert got == again


def test_metrics(spark):
    rows = spark.createDataFrame([(1,), (3,), (None,), (12,)], "r int")
    got = rows.agg(E.mrr(F.col("r"), 10), E.ndcg(F.col("r"), 10), E.recall(F.col("r"), 10)).first()
    assert tuple(got) == pytest.approx((1 / 3, 0.375, 0.5))
    p = spark.createDataFrame([(1,), (2,), (3,), (10,)], "r int").agg(*E.rank_stats(F.col("r"), "x")).first()
    assert (p["x_median"], p["x_p90"], p["x_p95"]) == (2.5, 7.9, 8.95)


def budget(texts, most, chars, per):
    out, used = [], 0
    for t in texts:
        t = t.strip()
        if len(out) >= most:
            break
        if not t:
            continue
        if chars - used < 200:
            break
        n = min(len(t), per, chars - used)
        out.append(t[:n])
        used += n
    return out


def test_budget_is_greedy(spark):
    rng = random.Random(3)
    cases = [[rng.choice(["", " "]) + "x" * rng.randint(0, 700) for _ in range(12)] for _ in range(60)]
    rows = spark.createDataFrame([(q, k, t) for q, ts in enumerate(cases) for k, t in enumerate(ts)], "query_id long, rank int, text string")
    got = {}
    for r in C.trim_to_budget(rows, 8, 1000, 600).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["text"])
    assert [got.get(q, []) for q in range(len(cases))] == [budget(ts, 8, 1000, 600) for ts in cases]


def keep_seeds(seeds, extra, total, per):
    total, out, docs = max(total, len(seeds)), [], {}
    for c in seeds:
        if c not in out:
            out.append(c)
            docs[c // 1_000_000] = docs.get(c // 1_000_000, 0) + 1
    for c in extra:
        if len(out) >= total:
            break
        if c not in out and docs.get(c // 1_000_000, 0) < per:
            out.append(c)
            docs[c // 1_000_000] = docs.get(c // 1_000_000, 0) + 1
    return out


def test_merge_is_greedy(spark):
    rng = random.Random(5)
    chunk = lambda: rng.randint(0, 3) * 1_000_000 + rng.randint(0, 9)
    cases = [(rng.sample([d * 1_000_000 + k for d in range(4) for k in range(9)], 4), list(dict.fromkeys(chunk() for _ in range(15)))) for _ in range(50)]
    frame = lambda at: spark.createDataFrame([(q, c, k) for q, x in enumerate(cases) for k, c in enumerate(x[at])], "query_id long, chunk_id long, rank int")
    got = {}
    for r in C.merge_keeping_seeds(frame(0), frame(1), 9, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert [got[q] for q in range(len(cases))] == [keep_seeds(s, e, 9, 3) for s, e in cases]


def test_sources_by_intent(spark):
    profiles = spark.createDataFrame([("a", "good", "required"), ("a", "fair", "preferred"), ("a", "bad", "excluded")], "intent string, source string, class string")
    order = ["bad", "none", "good", "fair", "none", "good"]
    hits = spark.createDataFrame([(1, k, s, k, "a") for k, s in enumerate(order)] + [(2, k, s, k, "b") for k, s in enumerate(order)], "query_id long, chunk_id long, source string, rank int, intent string")
    got = {}
    for r in R.filter_sources(hits, profiles, 4, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == {1: [2, 5, 3, 1], 2: [0, 1, 2, 3, 4, 5]}


def test_incremental_equals_rebuild(spark):
    rows = lambda v: spark.createDataFrame([(d, d * 1_000_000 + k, k, f"t{d}", f"word{k} {v if d % 2 else 'same'} shared") for d in range(6) for k in range(3)], "doc_id long, chunk_id long, chunk_index int, title string, text string")
    index = lambda r: I.postings(r).join(r.select("doc_id", "chunk_id"), "chunk_id")
    dirty = spark.createDataFrame([(d,) for d in (1, 3, 5)], "doc_id long")
    synced, built = sync(index(rows("old")), dirty, index(rows("new"))), index(rows("new"))
    assert sorted(map(str, synced.select(built.columns).collect())) == sorted(map(str, built.collect()))
    assert parents(rows("x"), 2).where("doc_id = 0").count() == 2


def test_status_null_is_active(spark):
    from siltstone.operators.audit import docs_without_chunks

    docs = spark.createDataFrame([(1, None), (2, 1), (3, 0)], "doc_id long, status int")
    chunks = spark.createDataFrame([(2, True)], "doc_id long, is_active boolean")
    assert [r["doc_id"] for r in docs_without_chunks(docs, chunks).collect()] == [1]


def test_upsert_keeps_id_and_source(spark):
    cols = "doc_id long, source string, url string, title string, raw_hash string, status int"
    old = spark.createDataFrame([(1, "a", "u1", "t", "h", 0)], cols)
    new = spark.createDataFrame([(9, "b", "u1", "T", "H", 0), (10, "b", "u2", "T", "H", 0)], cols)
    assert sorted(tuple(r) for r in N.upsert_docs(old, new).collect()) == [(1, "a", "u1", "T", "H", 1), (10, "b", "u2", "T", "H", 1)]


def test_split_has_no_leaks(spark):
    rows = spark.createDataFrame([(k, f"g{k % 37}") for k in range(1000)], "id long, g string")
    got = grouped_split(rows, "g", 0.1).groupBy("g").agg(F.count_distinct("split").alias("n"), F.first("split").alias("s"), F.count("*").alias("rows"))
    assert got.where("n > 1").isEmpty()
    assert 100 <= got.where("s = 'val'").agg(F.sum("rows")).first()[0] <= 100 + 28


def test_manifest_policies():
    assert I.check_manifest({"dims": 3}, {"dims": 4}, "warn") == ["dims: 3 instead of 4"] and I.check_manifest({}, {"a": 1}, "ignore") == []
    with pytest.raises(ValueError):
        I.check_manifest({"dims": 3}, {"dims": 4})


def test_embedding_survives_bad_texts(spark):
    from siltstone.functions.models import embed_column, hash_embedder

    def fussy(texts):
        if any("bad" in t for t in texts) or max(map(len, texts)) > 150:
            raise RuntimeError
        return hash_embedder(8)(texts)

    rows = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, "y" * 400)], "id long, text string")
    got = {r["id"]: r["v"] for r in rows.select("id", embed_column(fussy)("text").alias("v")).collect()}
    assert got[2] is None and len(got[1]) == 8 and len(got[3]) == 8


def test_dense_paths_agree(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(40)], "chunk_id long, embedding array<double>")
    q = rows.where("chunk_id < 5").withColumnRenamed("chunk_id", "query_id")
    for metric in ("ip", "l2"):
        shared, joined = R.dense_top_k(rows, q, 5, metric), R.dense_top_k(rows, q, 5, metric, most_queries=2)
        assert sorted(map(tuple, shared.collect())) == sorted(map(tuple, joined.select(shared.columns).collect()))


def test_bm25_paths_agree(spark):
    rows = spark.createDataFrame([(k, f"title {k % 3}", " ".join(f"w{(k * j) % 7}" for j in range(9))) for k in range(30)], "chunk_id long, title string, text string")
    terms = spark.createDataFrame([(1, "w3"), (1, "title"), (2, "w5"), (2, "w0")], "query_id long, term string")
    a, b = R.bm25(rows, terms, 10), R.bm25(rows, terms, 10, most_terms=1)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect())) and a.count() == 20


def test_changed_pages_source(spark):
    from siltstone.streaming.jobs import ChangedPages, _Changes

    pages = [(f"p{k}", "text", f"2024-01-{1 + k // 7:02d}") for k in range(40)]  # seven pages a day

    def fetch(since, most):
        due = [r for r in pages if r[2] >= since]
        return due[:most], max(0, len(due) - most)

    ChangedPages.FETCHERS["test"] = fetch
    reader = ChangedPages({"fetch": "test"})
    assert len(list(reader.reader(T.StructType()).read(None))) == 40
    stream = reader.simpleStreamReader(T.StructType())
    for most in (1, 3, 7, 8, 500):  # however a fetch falls on the days, every page comes once
        _Changes.PAGE, at, got = most, stream.initialOffset(), []
        while True:
            rows, after = stream.read(at)
            rows = list(rows)
            assert rows == list(stream.readBetweenOffsets(at, after))
            if not rows:
                break
            got, at = got + rows, after
        assert got == sorted(pages, key=lambda r: (r[2], r[0])) and after == at
    pages.append(("late", "text", "2024-01-06"))  # of a time that was read before
    assert [r[0] for r in stream.read(at)[0]] == ["late"]
    _Changes.PAGE = 500


def test_passages_are_found_in_one_pass(spark):
    rng = random.Random(5)
    docs = [(k, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))) for k in range(80)] + [(80, None), (81, "")]
    passages = [(k, "".join(rng.choice("abc ") for _ in range(rng.randint(1, 4)))) for k in range(40)] + [(40, ""), (41, None), (42, "zz"), (43, "ab"), (44, "ab")]
    from siltstone.operators import passages as P

    got = {tuple(r) for r in P.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "query_id long, passage string")).collect()}
    assert got == {(q, k) for q, p in passages for k, t in docs if p and t and p in t}


def test_titles_are_resolved_as_by_comparing_all(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abde") for _ in range(rng.randint(2, 6)))
    titles = [" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["", "The Old Mill: history", "Zürich"]
    entities = [(k, " ".join(rng.choice(titles[:300]).split()[:3]) or "x") for k in range(30)] + [(30, "old mil"), (31, None), (32, "nothing like it at all"), (33, "!!")]
    got = {r["query_id"]: (r["title"], r["score"]) for r in R.resolve_titles(spark.createDataFrame(entities, "query_id long, entity string"), spark.createDataFrame([(t,) for t in titles], "title string"), most_entities=7).collect()}
    for k, e in entities:
        scores = [(Q.similarity(e, t), t) for t in titles] if e else []
        best = max(scores, default=(0, ""))
        want = (best[1], round(best[0], 6)) if best[0] >= 0.84 else (None, None)
        assert got.get(k, (None, None)) == want, e


def test_zstd_round_trip(spark):
    from siltstone.sources.files import unzstd, zstd

    rows = spark.createDataFrame([("hello " * 50,), (None,), ("",)], "t string").select("t", unzstd(zstd(F.encode("t", "utf-8"))).cast("string").alias("u"))
    assert all(r["t"] == r["u"] for r in rows.collect())


def test_ivf_finds_what_exact_search_finds(spark):
    def hits(name):
        out = {}
        for r in QUERIES[name](spark, DIR).collect():
            out.setdefault(r["query_id"], set()).add(r["chunk_id"])
        return out

    want, got = hits("f1_dense_topk_exact"), hits("f2_dense_topk_ivf")
    recall = [len(got[q] & want[q]) / len(want[q]) for q in want]
    assert min(recall) >= 0.9, sum(recall) / len(recall)
