"""Search at size: what tasks hold and pass on, against naive versions."""

import math
import random
import re
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from siltstone.functions.models import hash_embedder
from siltstone.operators import indexes as I
from siltstone.operators import retrieval as R

CHUNKS = "chunk_id long, title string, text string"


def chunks_of(spark, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(25)] + ["Ciónes", "cation", "é", "a_b"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    titles = [text(3), text(40), None, "", "w1 w1"]
    rows = [(k, rng.choice(titles), rng.choice([None, "", text(rng.randint(1, 30)), text(5)])) for k in range(300)]
    return rows, spark.createDataFrame(rows, CHUNKS).repartition(3).sortWithinPartitions("chunk_id")


def found(t):
    return re.findall(r"[^\W_]+", (t or "").lower().translate(str.maketrans("óé", "oe")))


def best(scores, k):
    return [(c, n + 1) for n, (c, _) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]


def hits(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["chunk_id"], r["rank"]))
    return out


def test_bm25_as_by_scoring_all(spark):
    rows, frame = chunks_of(spark)
    asked = {1: ["w1", "w2", "ciones"], 2: ["w3", "cation", "a_b"], 3: ["nothing"], 4: ["W5", "w5"]}
    terms = spark.createDataFrame([(q, t) for q, own in asked.items() for t in own], "query_id long, term string")
    lengths = {c: len(found(a)) + len(found(b)) for c, a, b in rows}
    mean, want = sum(lengths.values()) / len(rows), {}
    for q, own in asked.items():
        scores = {}
        for t in {t.lower() for t in own}:
            f = {c: n for c, a, b in rows if (n := 4 * found(a).count(t) + found(b).count(t))}
            idf = math.log((len(rows) - len(f) + 0.5) / (len(f) + 0.5))
            for c, n in f.items():
                scores[c] = scores.get(c, 0) + (idf if idf > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * lengths[c] / mean))
        if scores:
            want[q] = best({c: round(s, 6) for c, s in scores.items()}, 20)
    assert hits(R.bm25(frame, terms, 20)) == want
    assert hits(R.bm25(frame, terms, 20, most_terms=2)) == want
    assert R.bm25(frame.limit(0), terms, 20).isEmpty() and R.bm25(frame, terms.limit(0), 20).isEmpty()


def test_sparse_search_as_over_an_index(spark):
    _, frame = chunks_of(spark)
    q = spark.createDataFrame([(1, 5, 1.0), (1, 5, 1.0), (1, 9, 0.5), (2, 60, 2.0), (2, 3, -1.0), (3, 4000, 1.0)], "query_id long, term_id int, weight double")
    for most in (256, 4):
        index = I.sparse_index(frame, 64, most).checkpoint()
        scored = index.join(q.groupBy("query_id", "term_id").agg(F.sum("weight").alias("q")), "term_id").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("q") * F.col("weight")), 6).alias("score"))
        want = hits(R.ranked(scored.where("score > 0"), 20))
        assert want and max(r["n"] for r in index.groupBy("chunk_id").agg(F.count("*").alias("n")).collect()) <= most
        assert hits(R.sparse_search(frame, q, 20, 64, most)) == hits(R.sparse_top_k(index, q, 20)) == hits(R.sparse_top_k(index, q, 20, most_terms=2)) == want


def test_tasks_pass_on_their_best_hits_only(spark, monkeypatch):
    """What is ranked grows with tasks, queries and k, not with chunks."""
    seen, ranked = [], R.ranked
    monkeypatch.setattr(R, "ranked", lambda scored, k, by=None: seen.append((scored.count(), scored.rdd.getNumPartitions())) or ranked(scored, k, by))
    frame = spark.createDataFrame([(k, "same", "word " * (1 + k % 7)) for k in range(900)], CHUNKS).repartition(3)
    terms = spark.createDataFrame([(q, "word") for q in range(4)], "query_id long, term string")
    R.bm25(frame, terms, 5)
    index = I.sparse_index(frame, 64)
    R.sparse_top_k(index, terms.crossJoin(index.select("term_id").distinct()).select("query_id", "term_id", F.lit(1.0).alias("weight")), 5)
    v = frame.select("chunk_id", F.array((F.col("chunk_id") % 11).cast("double"), F.lit(1.0)).alias("embedding"))
    R.dense_top_k(v, v.where("chunk_id < 4").withColumnRenamed("chunk_id", "query_id"), 5)
    assert len(seen) == 3 and all(n <= tasks * 4 * 5 for n, tasks in seen), seen


def test_embedder_as_word_by_word():
    texts = ["One two two, three", "", None, "x " * 50 + "é y1", "İΣ ñ3_a'B-c ßx"]
    for t, v in zip(texts, hash_embedder(8)(texts)):
        want = np.zeros(8)
        for w in set(re.findall("[a-z0-9]+", (t or "").lower())):
            h = int(md5(w.encode()).hexdigest()[:8], 16)
            want[h % 8] += 1 if h >> 16 & 1 else -1
        assert np.allclose(v, want / (np.linalg.norm(want) or 1))
