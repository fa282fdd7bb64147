"""The registered queries: against SQL where there is some, else that they run over whole tables."""

import hashlib
import math
from collections import Counter

import pyarrow as pa
import pytest
from compare import DIR, assert_same
from test_operators import naive_bucket, naive_grams

import corpus_pipeline
from siltstone.llm import simhash, toxicity
from siltstone.llm.packing import PackParams, best_fit
from siltstone.llm.queries import ORACLE_SQL, QUERIES
from siltstone.llm.token_counts import counter, encoder


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_pipeline_by_hand(spark):
    """run() gives what the stages give one after the other, and each does its part."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, DIR).checkpoint()
        assert after.exceptAll(kept).isEmpty(), name
        if name == "exact_dedup":
            assert after.count() == after.select("text").distinct().count() == kept.select("text").distinct().count()
        kept = after
    got = corpus_pipeline.run(spark, DIR)
    want = sum(r["n"] for r in kept.select(counter(PackParams().vocabulary)("text").alias("n")).collect())
    assert got.agg({"tokens": "sum"}).first()[0] == want
    assert got.groupBy("shard", "bin").sum("tokens").where("`sum(tokens)` > 2048").isEmpty()


def test_stages_against_naive_versions(spark):
    """Every stage over all documents against a version in plain Python that looks at one row, or one pair, at a time."""
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()
    p = toxicity.ToxicityParams()
    table, shift, least = toxicity.train(docs, labels, p)

    def toxic(text):
        grams = [naive_bucket(g, p.bucket_bits) for g in naive_grams(text or "", p)]
        return bool(grams) and sum(float(table[g]) for g in grams) / (len(grams) + p.blank) + shift - least >= 0

    kept = stages["toxicity"](spark, docs, DIR).checkpoint()
    rows = [r for r in rows if not toxic(r["text"])]
    assert ids(kept.collect()) == ids(rows)

    kept = stages["exact_dedup"](spark, kept, DIR).checkpoint()
    least_id = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        least_id.setdefault(r["text"], r["doc_id"])
    rows = [r for r in rows if r["text"] is None or least_id[r["text"]] == r["doc_id"]]
    assert ids(kept.collect()) == ids(rows)

    after = stages["simhash_near_dedup"](spark, kept, DIR).checkpoint()
    sims, some = simhash.simhashes(pa.array([r["text"] for r in rows], pa.string()))
    whole = [int.from_bytes(s.tobytes(), "little") for s in sims]
    place = {r["doc_id"]: k for k, r in enumerate(rows)}
    stay = set(ids(after.collect()))
    near = lambda a, b: (whole[a] ^ whole[b]).bit_count() <= 43
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if some[a] and some[b] and near(a, b)]
    for r in rows:  # what goes has a near copy, with a smaller doc_id, that stays
        k = place[r["doc_id"]]
        assert r["doc_id"] in stay or any(near(k, j) and rows[j]["doc_id"] in stay and rows[j]["doc_id"] < r["doc_id"] for j in range(len(rows)) if some[j])
    alone = set(place.values()) - {k for pair in pairs for k in pair}
    assert all(rows[k]["doc_id"] in stay for k in alone)
    assert sum(not (rows[a]["doc_id"] in stay and rows[b]["doc_id"] in stay) for a, b in pairs) >= 0.9 * len(pairs)
    rows = [r for r in rows if r["doc_id"] in stay]

    mixed = stages["mixing"](spark, after, DIR).checkpoint()
    h = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:13], 16)
    cells = {}
    for r in rows:
        cells.setdefault((r["source"], h(29, r["doc_id"]) % 8), []).append((h(29, r["doc_id"]), r["doc_id"], len((r["text"] or "").split())))
    tokens, blocks = Counter(), {}
    for cell, own in cells.items():
        tokens[cell[0]] += sum(n for *_, n in own)
        blocks[cell] = max(1, int((2 * sum(n for *_, n in own) + 2048) // 4096))
    supply = Counter()
    for (source, _), n in blocks.items():
        supply[source] += n
    take = lambda w, caps, seats: Counter(s for _, s in sorted((-w[s] / (2 * k + 1), s) for s in caps for k in range(caps[s]))[:seats])
    won = take({s: math.sqrt(n) for s, n in tokens.items()}, supply, math.ceil(0.9 * sum(supply.values()) - 1e-9))
    want = []
    for source in supply:
        caps = {shard: n for (s, shard), n in blocks.items() if s == source}
        for shard, quota in take(caps, caps, won[source]).items():
            upto, total, n = 0, sum(x for *_, x in cells[source, shard]), caps[shard]
            for _, doc, size in sorted(cells[source, shard]):
                block = min(n - 1, upto * n // total) if total else 0
                if (block - h(30, source, shard)) % n < quota:
                    want.append(doc)
                upto += size
    assert ids(mixed.collect()) == sorted(want)
    rows = [r for r in rows if r["doc_id"] in set(want)]

    got = stages["packing"](spark, mixed, DIR).collect()
    enc = encoder(PackParams().vocabulary)
    sizes = Counter()
    for r in got:
        sizes[r["doc_id"]] += r["tokens"]
    assert dict(sizes) == {r["doc_id"]: n for r in rows if (n := len(enc.encode_ordinary(r["text"] or "")))}
    for shard in {r["shard"] for r in got}:
        own = [r for r in got if r["shard"] == shard]
        load = Counter()
        for r in own:
            load[r["bin"]] += r["tokens"]
        pieces = [r["tokens"] for r in own if r["tokens"] < 2048]
        assert max(load.values()) <= 2048 and len(load) - sum(r["tokens"] == 2048 for r in own) <= len(best_fit(pieces, 2048))
