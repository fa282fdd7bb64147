"""Queries of the graph, training records, crawling and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dataset as D
from ..operators import graph as G
from ..operators.chunking import chunk_documents
from ..sources.crawl import crawl, link_edges
from ..sources.files import current, promote, read_markdown, shared_folder, snapshot
from ..streaming import jobs as S
from .registry import query, table
from .search_queries import HYDRATED, POS, hydrated, positives
from .sql import CHUNKS, marker_sql, squeeze_sql, trim_sql

_GROUPS = "[" + ", ".join(f"case when {marker_sql('lower(text)', m)} then '{g}' end" for g, m in sorted(G.MARKERS.items())) + "]"


@query("l1_relation_marker_hits", CHUNKS + f"select chunk_id, groups from (select chunk_id, array_to_string(list_filter({_GROUPS}, lambda x: x is not null), ',') as groups from chunks) where groups <> ''")
def l1(spark, d):
    return chunk_documents(table(spark, d, "documents")).select("chunk_id", F.array_join(G.marker_hits(F.col("text")), ",").alias("groups")).where("groups <> ''")


#: A stand-in for a model's extraction: a JSON object made of the first words of a passage.
_W = "split_part(text, ' ', {})"
_JSON = """'{"entities": [{"name": "' || a || '", "type": "Person", "aliases": []}, {"name": "' || b || '", "type": "thing", "aliases": []}, {"name": "' || lower(a) || '", "type": "place", "aliases": []}], "relationships": [{"source": "' || a || '", "target": "' || b || '", "type": "member of", "confidence": 1.5}, {"source": "' || a || '", "target": "' || a || '", "type": "knows", "confidence": 0.5}, {"source": "' || b || '", "target": "' || a || '", "type": "knows", "confidence": 0.4}, {"source": "' || a || '", "target": "nobody else", "type": "knows", "confidence": 0.4}]}'"""
_WORDS = "select conv_id * 1000 + turn as chunk_id, regexp_replace(split_part(text, ' ', 1), '[^a-zA-Z]', 'x'{g}) as a, regexp_replace(split_part(text, ' ', 2), '[^a-zA-Z]', 'y'{g}) as b from conversations"


def answers(spark, d):
    rows = spark.sql(_WORDS.replace("{g}", "").replace("from conversations", "from {conversations}"), conversations=table(spark, d, "conversations"))
    return rows.select("chunk_id", F.concat(F.lit("<think>hm</think>```json "), F.expr(_JSON), F.lit("```")).alias("answer"))


_ENT = "with w as (" + _WORDS.replace("{g}", ", 'g'") + "), p as (select chunk_id, trim(lower(a)) as ka, trim(lower(b)) as kb, a, b from w)"


@query("l2_extract_graph", _ENT + """, r as (select chunk_id, ka as source_key, kb as target_key, 'MEMBER_OF' as type, 1.0::double as confidence from p where ka <> kb and ka <> '' and kb <> ''
union all select chunk_id, kb, ka, 'RELATED_TO', 0.4::double from p where ka <> kb and ka <> '' and kb <> '') select * from r""")
def l2(spark, d):
    parsed = G.parse_extraction(answers(spark, d))
    return G.relations(parsed, G.entities(parsed))


@query("l3_prepare_extraction", _ENT + """ select chunk_id, ka as key, a as name, 'person' as type from p where ka <> '' union all select chunk_id, kb, b, 'unknown' from p where kb <> '' and kb <> ka""")
def l3(spark, d):
    return G.entities(G.parse_extraction(answers(spark, d)))


@query("l4_graph_upsert_chunk", _ENT + """, m as (select chunk_id, ka as key, 'new' as v from p where ka <> '' union select chunk_id, kb, 'new' from p where kb <> '')
select chunk_id, key, case when chunk_id % 3 = 0 then 'new' else 'old' end as v from m""")
def l4(spark, d):
    m = G.entities(G.parse_extraction(answers(spark, d))).select("chunk_id", "key")
    return G.replace_chunks(m.withColumn("v", F.lit("old")), m.where("chunk_id % 3 = 0").withColumn("v", F.lit("new")), m.where("chunk_id % 3 = 0"))


@query("l5_graph_state_diff", CHUNKS + "select chunk_id, case when chunk_id % 5 = 0 then 'NEW' when chunk_id % 7 = 0 then 'DELETED' else 'CHANGED' end as action from chunks where chunk_id % 5 = 0 and chunk_id % 7 <> 0 or chunk_id % 5 <> 0 and (chunk_id % 7 = 0 or chunk_id % 11 = 0)")
def l5(spark, d):
    c = chunk_documents(table(spark, d, "documents")).select("chunk_id", F.col("chunk_hash").alias("hash"), F.lit("s1").alias("signature"))
    stored = c.where("chunk_id % 5 <> 0").withColumn("hash", F.when(F.col("chunk_id") % 11 == 0, "x").otherwise(F.col("hash")))
    return G.state_diff(stored, c.where("chunk_id % 7 <> 0"))


@query("l6_graph_orphans", _ENT + """, m as (select chunk_id, ka as key from p where ka <> '' union select chunk_id, kb from p where kb <> '')
select distinct key from m where key not in (select key from m where chunk_id % 4 <> 0) and key not in (select ka from p where chunk_id % 6 = 0 and ka <> kb and ka <> '' and kb <> '' union all select kb from p where chunk_id % 6 = 0 and ka <> kb and ka <> '' and kb <> '')""")
def l6(spark, d):
    parsed = G.parse_extraction(answers(spark, d))
    m = G.entities(parsed)
    edges = G.relations(parsed, m).where("chunk_id % 6 = 0")
    return G.orphan_entities(m.select("key").distinct(), m.where("chunk_id % 4 <> 0"), edges)


@query("l7_extractor_signature", f"select sha256('{{\"entity_types\":\"{','.join(G.ENTITY_TYPES)}\",\"relation_types\":\"{','.join(G.RELATION_TYPES)}\"}}') as signature")
def l7(spark, d):
    return spark.range(1).select(X.stable_json_hash(F.lit(",".join(G.ENTITY_TYPES)).alias("entity_types"), F.lit(",".join(G.RELATION_TYPES)).alias("relation_types")).alias("signature"))


@query("l8_graph_neighbours", _ENT + """, e as (select ka as a, kb as b from p where ka <> kb and ka <> '' and kb <> '' union select kb, ka from p where ka <> kb and ka <> '' and kb <> ''),
s0 as (select distinct ka as key from p where ka <> ''), s1 as (select distinct b as key from e where a in (select key from s0) and b not in (select key from s0)),
s2 as (select distinct b as key from e where a in (select key from s1) and b not in (select key from s0 union all select key from s1))
select key, 0 as hops from s0 union all select key, 1 from s1 union all select key, 2 from s2""")
def l8(spark, d):
    """From all entities that are a person somewhere."""
    parsed = G.parse_extraction(answers(spark, d))
    named = G.entities(parsed)
    return G.neighbours(G.relations(parsed, named), named.where("type = 'person'"), 2)


@query("m3_pair_gate", f"""
select conv_id, turn, case when turn % 5 = 4 then 'positive_not_selected' when role = 'system' then 'empty_context' when {trim_sql('text')} = '' then 'empty_answer'
  when {' or '.join(f"contains(lower(text), '{m}')" for m in X.ANSWER_ARTEFACTS)} or regexp_matches(lower({trim_sql('text')}), '^answer:') then 'answer_style'
  when {' or '.join("contains(lower(text), '" + m.replace("'", "''") + "')" for m in X.REFUSALS)} then 'refusal' end as reject_reason from conversations""")
def m3(spark, d):
    c = table(spark, d, "conversations")
    rows = c.select("conv_id", "turn", F.col("text").alias("answer"), F.when(F.col("role") != "system", "some").alias("context"), (F.col("turn") % 5 != 4).alias("positive_selected"))
    return D.pair_gate(rows).select("conv_id", "turn", "reject_reason")


@query("m4_sft_record", "select 'sft_' || conv_id as id, count(*)::int as n_messages, string_agg(role || ': ' || text, chr(10) order by turn, role, text) as dialogue from conversations group by conv_id")
def m4(spark, d):
    r = D.message_records(table(spark, d, "conversations"))
    return r.select("id", F.size("messages").alias("n_messages"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("dialogue"))


@query("m5_hard_negatives", HYDRATED + POS + """, n as (select h.query_id, h.chunk_id, h.doc_id, h.rank, row_number() over (partition by h.query_id, h.doc_id order by h.rank) as n from h join pos p on p.query_id = h.query_id where h.doc_id <> p.doc_id and length(h.text) >= 350)
select query_id, chunk_id, doc_id, k::int as k from (select *, row_number() over (partition by query_id order by rank) as k from n where n = 1) where k <= 5""")
def m5(spark, d):
    return D.hard_negatives(hydrated(spark, d), positives(spark, d), F.length("text") >= 350)


@query("m6_easy_negatives", CHUNKS.replace("with recursive", "with recursive pos as (select item_id as query_id, min(doc_id) as doc_id from benchmark b join documents d on contains(d.text, b.text) group by 1),", 1) + """
, g as (select chunk_id, doc_id, ('0x' || substr(md5('7|' || chunk_id), 1, 8))::bigint as h from chunks where text_len >= 350),
n as (select greatest(64, count(*) // 64) as n from g),
o as (select g.*, h % n as slot from g, n qualify row_number() over (partition by h % n, doc_id order by h, chunk_id) = 1),
pl as (select *, row_number() over (partition by slot order by h, chunk_id) as place from o),
m as (select query_id, chunk_id, pl.doc_id, row_number() over (partition by query_id order by place) as k from pos join pl on ('0x' || substr(md5('7|' || query_id), 1, 8))::bigint % (select n from n) = slot where place <= 6 and pl.doc_id <> pos.doc_id)
select query_id, chunk_id, doc_id, k::int as k from m where k <= 5""")
def m6(spark, d):
    return D.easy_negatives(chunk_documents(table(spark, d, "documents")), positives(spark, d), F.col("text_len") >= 350)


@query("m7_negative_leaks", HYDRATED + f"select query_id, chunk_id, length({squeeze_sql('lower(question)')}) >= 8 and contains({squeeze_sql('lower(text)')}, {squeeze_sql('lower(question)')}) as leaks from h")
def m7(spark, d):
    return hydrated(spark, d).select("query_id", "chunk_id", D.leaks(F.col("text"), F.col("question")).alias("leaks"))


@query("m8_output_dedupe", f"""
with c as (select conv_id * 1000 + turn as seq, 'qa_' || conv_id || '_' || turn as id, text as question from conversations),
r as (select * from c union all select seq + 1000000000000, id, question || ' again' from c where length(question) % 3 = 0),
a as (select * from r qualify row_number() over (partition by id order by seq, question) = 1)
select id, seq, question from a qualify row_number() over (partition by {squeeze_sql('lower(question)')} order by seq, id) = 1""")
def m8(spark, d):
    """Every turn as a question; some are asked once more, later, under the same id."""
    rows = table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.concat(F.lit("qa_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("question")
    )
    again = rows.where(F.length("question") % 3 == 0).select(F.col("seq") + 1000000000000, "id", F.concat("question", F.lit(" again")))
    return D.dedupe_records(rows.unionAll(again)).select("id", "seq", "question")


@query("m9_grouped_split", """
with s as (select source || doc_id % 40 as g, count(*) as n from documents group by 1), o as (select g, n, sum(n) over (order by sha256('1337|' || g), g rows unbounded preceding) - n as before from s)
select doc_id, case when before < (select greatest(1, floor(count(*) * 0.05)) from documents) then 'val' else 'train' end as split from documents join o on g = source || doc_id % 40""")
def m9(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat("source", (F.col("doc_id") % 40).cast("string")).alias("g"))
    return D.grouped_split(rows, "g").select("doc_id", "split")


@query("m10_bundle_join", """
with a as (select 'sft_' || conv_id as id, arg_max(text, turn) filter (role = 'assistant') as answer from conversations group by conv_id),
p as (select 'sft_' || conv_id as id, arg_max(text, turn) as query from conversations where role = 'user' group by conv_id)
select id, query, answer, 'hard:1,easy:2' as negatives from p join a using (id)""")
def m10(spark, d):
    c = table(spark, d, "conversations")
    pairs = c.where("role = 'user'").select(F.concat(F.lit("sft_"), F.col("conv_id").cast("string")).alias("origin_record_id"), F.col("text").alias("query"), F.col("turn").alias("seq"), F.array(F.lit(1)).alias("hard"), F.array(F.lit(2)).alias("easy"))
    joined = F.array_join(F.transform("negatives", lambda x: F.concat(x["type"], F.lit(":"), x["chunk_id"].cast("string"))), ",")
    return D.bundles(D.message_records(c), pairs).select("id", "query", "answer", joined.alias("negatives"))


@query("m11_evidence_merge", """
with e as (select page_id // 10 as record_id, regexp_replace(url, '#.*$', '') as url, page_id as search_rank, html as text from pages),
f as (select * from e qualify row_number() over (partition by record_id, url order by search_rank) = 1),
o as (select *, coalesce(sum(length(text)) over (partition by record_id order by search_rank, url rows between unbounded preceding and 1 preceding), 0) as before from f)
select record_id, url, (row_number() over (partition by record_id order by search_rank, url))::int as rank, substr(text, 1, (20000 - before)::int) as text from o where before < 20000""")
def m11(spark, d):
    rows = table(spark, d, "pages").select(F.floor(F.col("page_id") / 10).alias("record_id"), F.regexp_replace("url", "#.*$", "").alias("url"), F.col("page_id").alias("search_rank"), F.lit("s").alias("source"), F.col("html").alias("text"))
    return D.merge_evidence(rows, 20000)


_JUDGED = """select doc_id % 50 as record_id, source, case when doc_id % 3 = 0 then 'primary' else 'supplementary' end as tier, 0.5 + (doc_id % 5) / 10.0{D} as source_weight, (n_chars % 100) / 100.0{D} as relevance, doc_id % 4 <> 1 as supports, doc_id % 37 = 1 as contradicts from documents"""


@query("m12_evidence_gates", "with j as (" + _JUDGED.replace("{D}", "::double") + """), s as (select *, relevance * (0.85 + 0.15 * case when tier = 'primary' then 1.0 else 0.6 end * source_weight) as score from j),
p as (select record_id, round(coalesce(max(score) filter (supports and tier = 'primary'), 0), 6) as primary_support, count(distinct source) filter (supports and score >= 0.72) as supporting_sources, round(coalesce(max(score) filter (contradicts), 0), 6) as contradiction from s group by 1)
select *, (primary_support >= 0.82 or supporting_sources >= 2) and contradiction < 0.7 as verified from p""")
def m12(spark, d):
    return D.evidence_gates(spark.sql(_JUDGED.replace("{D}", "D").replace("from documents", "from {documents}"), documents=table(spark, d, "documents")))


@query("m14_apply_verdicts", "select 'doc_' || doc_id as id, source as meta_source, coalesce(quality = 1, false) as validated from documents left join labels using (doc_id)")
def m14(spark, d):
    key = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id")
    records = table(spark, d, "documents").select(key, F.struct("source").alias("metadata"))
    verdicts = table(spark, d, "labels").select(key, (F.col("quality") == 1).alias("verified"))
    return D.apply_verdicts(records, verdicts).select("id", F.col("metadata.source").alias("meta_source"), F.col("metadata.answer_support_validated").alias("validated"))


@query("k8_resume_completed", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def k8(spark, d):
    return D.not_done(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("k7_ordered_emit", "select user_id, min(event_id) as event_id from events where user_id not in (select user_id from events where event_type = 'error' and event_id < 100) group by 1")
def k7(spark, d):
    e = table(spark, d, "events")
    left = D.not_done(e, e.where("event_type = 'error' and event_id < 100"), "user_id")
    return left.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("n = 1").select("user_id", "event_id")


@query("k3_dirty_latest_stream", "select user_id as doc_id, arg_max(event_type, [epoch_us(ts)::varchar, event_type]) as reason from events group by 1")
def k3(spark, d):
    """The feed as a stream of files with last-write-wins state; the last change of each document is what the batch form gives."""
    e = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/*events.parquet")
    feed = e.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("reason"), F.col("ts").cast("timestamp").alias("marked_at"))
    changes = S.run_updates(S.latest_marks(feed), f"{shared_folder(spark)}/marks-{uuid.uuid4().hex}")
    return changes.groupBy("doc_id").agg(F.max_by("reason", F.struct("batch", "marked_at", "reason")).alias("reason"))


def _events(spark, d):
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/*events.parquet")


@query("k9_tumbling_windows_stream", """
with w as (select date_trunc('day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2)
select epoch(day)::bigint as start, event_type, n, total from w where day + interval 1 day <= (select max(ts) - interval 1 hour from events)""")
def k9(spark, d):
    """Append mode: windows that the watermark has passed."""
    out = S.run_to_table(S.tumbling(_events(spark, d)), f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}")
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total")


@query("k10_session_windows", """
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as s from events), n as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, epoch_us(min(ts)) as start, epoch_us(max(ts)) + 21600000000 as end, count(*) as n from n group by user_id, k""")
def k10(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "n")


@query("k1_ingest_stream", CHUNKS + "select doc_id, count(*) as n from chunks group by 1")
def k1(spark, d):
    """Documents as a stream of files, chunked batch by batch into a table."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"

    def process(rows, batch):
        chunk_documents(rows).write.mode("overwrite").parquet(f"{folder}/chunks/batch={batch}")  # a batch that is tried again replaces its rows

    S.ingest(S.landed(spark, f"{d}/*documents.parquet", table(spark, d, "documents").schema), process, f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/chunks").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("a2_changed_pages", "select 'p' || page_id as title, length(html) as n, '2024-01-0' || (page_id % 3 + 1) as changed from pages")
def a2(spark, d):
    """Pages of a source of changes, batch by batch, into a table: many share a time, and none is lost or read twice."""
    folder = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    spark.dataSource.register(S.ChangedPages)
    pages = spark.readStream.format("changed_pages").option("fetch", "siltstone.streaming.jobs:parquet_pages").option("path", f"{d}/pages.parquet").load()

    def process(rows, batch):
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    stream = pages.writeStream.foreachBatch(process).option("checkpointLocation", f"{folder}/state").start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.read.parquet(f"{folder}/out").select("title", F.length("text").alias("n"), "changed")


@query("a3_site_crawl")
def a3(spark, d):
    p = table(spark, d, "pages")
    return crawl(p, p.where("page_id % 10 = 0"), F.col("dst").rlike(r"^https?://[^/]*example\."), 2)


@query("a3_link_edges", """
select distinct regexp_replace(url, '#.*$', '') as src, regexp_replace(case when h like 'http%' then h else regexp_extract(url, '^https?://[^/?#]+') || h end, '#.*$', '') as dst
from (select url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as h from pages)""")
def a3e(spark, d):
    return link_edges(table(spark, d, "pages"))


@query("a1_markdown_repo", "select 'md://pages/p' || page_id || '.md' as url, 'p' || page_id as title, '# ' || url as text from pages")
def a1(spark, d):
    """Writes every page's address as a Markdown file, with a README that is to be skipped, and reads the folder."""
    from ..sources.files import write_files

    folder = f"{shared_folder(spark)}/md-{uuid.uuid4().hex}"
    rows = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".md")).alias("name"), F.concat(F.lit("# "), "url").alias("text"))
    write_files(rows.unionAll(spark.createDataFrame([("README.md", "no")], "name string, text string")), folder)
    return read_markdown(spark, folder, "pages")


@query("a11_atomic_promote", "select vec_id, label from embeddings where vec_id % 2 = 0")
def a11(spark, d):
    root = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    e = table(spark, d, "embeddings").select("vec_id", "label")
    promote(e, root)
    promote(e.where("vec_id % 2 = 0"), root)
    return current(spark, root)


@query("a15_snapshot", "select count(*) as n from embeddings")
def a15(spark, d):
    root = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    promote(table(spark, d, "embeddings"), root)
    return spark.createDataFrame([(snapshot(spark, root, f"{root}-copy"),)], "n long")
