"""Queries of ingest, views, audits and derived indexes. Stored tables are derived from the documents, with gaps of known kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit as A
from ..operators import indexes as I
from ..operators import ingest as N
from ..operators.chunking import chunk_documents, parent_map, parents, sync, with_titles
from ..operators.retrieval import few
from .registry import query, table
from .sql import CHUNKS, trim_sql

_NORM = r"regexp_replace(regexp_replace(nfc_normalize(text), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
STORE = CHUNKS + f""", docs as (
  select doc_id, source, 'doc://' || source || '/' || doc_id as url, split_part(text, chr(10), 1) as title, sha256(text) as raw_hash, sha256({trim_sql(_NORM)}) as norm_hash,
    case when doc_id % 50 = 7 then 0 when doc_id % 50 = 8 then null else 1 end as status, text from documents
), stored as (
  select *, doc_id % 40 <> 3 and not (chunk_index = 1 and doc_id % 10 = 4) as is_active from chunks
), vectors as (select chunk_id from stored where chunk_id % 7 <> 0)
"""


def docs(spark, d):
    c = F.col("doc_id") % 50
    return with_titles(table(spark, d, "documents")).select(
        "*", F.sha2("text", 256).alias("raw_hash"), F.sha2(X.normalize_text(F.col("text")), 256).alias("norm_hash"),
        F.when(c == 7, 0).when(c == 8, F.lit(None)).otherwise(1).cast("int").alias("status"),
    )


def stored(spark, d, documents=None, carry=()):
    on = (F.col("doc_id") % 40 != 3) & ~((F.col("chunk_index") == 1) & (F.col("doc_id") % 10 == 4))
    return chunk_documents(table(spark, d, "documents") if documents is None else documents, carry=carry).withColumn("is_active", on)


def vectors(chunks):
    return chunks.where("chunk_id % 7 <> 0").select("chunk_id")


@query("a8_jsonl_round_trip", "select conv_id, turn, role, text from conversations")
def a8(spark, d):
    """Writes lines of JSON beside the checkpoints and reads them with their schema, strictly."""
    import uuid

    from ..sources.files import read_jsonl, shared_folder, write_jsonl

    rows = table(spark, d, "conversations")
    path = f"{shared_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    write_jsonl(rows, path)
    return read_jsonl(spark, path, rows.schema)


@query("a9_export_active_chunks", STORE + "select s.chunk_id, s.doc_id, s.chunk_index, s.text, d.source, d.url, d.title, 1.0::double as weight from stored s join docs d using (doc_id) where is_active")
def a9(spark, d):
    rows = stored(spark, d, docs(spark, d), ("source", "url", "title")).where("is_active")
    return rows.select("chunk_id", "doc_id", "chunk_index", "text", "source", "url", "title", F.lit(1.0).alias("weight"))


@query("a10_import_vectors", "select vec_id as chunk_id, round(case when vec_id % 3 = 0 then -embedding[1] else embedding[1] end::double, 6) as first from embeddings")
def a10(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    new = e.where("chunk_id % 3 = 0").select("chunk_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    return N.upsert_vectors(e, new).select("chunk_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("c1_doc_change_detect", STORE + """
, incoming as (select case when doc_id % 11 = 0 then url || '/new' else url end as url, case when doc_id % 5 = 0 then sha256(text || 'x') else raw_hash end as raw_hash from docs),
state as (select doc_id, count(*) as n, count(*) - count(v.chunk_id) as missing from stored s left join vectors v using (chunk_id) where is_active group by 1)
select i.url, d.doc_id, case when d.doc_id is null then 'NEW' when d.raw_hash <> i.raw_hash then 'CHANGED' when coalesce(n, 0) = 0 then 'REBUILD_NO_CHUNKS' when missing > 0 then 'EMBED_ONLY' else 'UNCHANGED' end as status
from incoming i left join docs d using (url) left join state using (doc_id)""")
def c1(spark, d):
    rows, chunks = docs(spark, d), stored(spark, d)
    url = F.when(F.col("doc_id") % 11 == 0, F.concat("url", F.lit("/new"))).otherwise(F.col("url"))
    digest = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("raw_hash"))
    return N.detect_changes(rows.select(url.alias("url"), digest.alias("raw_hash")), rows, chunks, vectors(chunks))


@query("c2_url_move_detect", STORE + ", m as (select doc_id, max(doc_id) over (partition by source, raw_hash) as moved_to from docs) select * from m where doc_id < moved_to")
def c2(spark, d):
    return N.moved(docs(spark, d))


@query("c3_exact_dup_reject", STORE + "select min(doc_id) as doc_id, source, norm_hash from docs group by source, norm_hash")
def c3(spark, d):
    return N.reject_exact_duplicates(docs(spark, d).select("doc_id", "source", "norm_hash"))


@query("c4_doc_upsert", STORE + """
, b as (select doc_id + 1000000000 as doc_id, 'moved' as source, case when doc_id % 2 = 0 then url else url || '/v2' end as url, title || ' v2' as title, norm_hash as raw_hash from docs where doc_id % 4 < 2)
select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.source, b.source) as source, coalesce(a.url, b.url) as url, case when b.url is null then a.title else b.title end as title,
  case when b.url is null then a.raw_hash else b.raw_hash end as raw_hash, case when b.url is null then a.status else 1 end as status from docs a full join b on a.url = b.url""")
def c4(spark, d):
    rows = docs(spark, d)
    url = F.when(F.col("doc_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/v2")))
    new = rows.where("doc_id % 4 < 2").select((F.col("doc_id") + 1000000000).alias("doc_id"), F.lit("moved").alias("source"), url.alias("url"), F.concat("title", F.lit(" v2")).alias("title"), F.col("norm_hash").alias("raw_hash"))
    return N.upsert_docs(rows.select("doc_id", "source", "url", "title", "raw_hash", "status"), new)


_NEW = ", fresh as (select doc_id, chunk_index, sha256(text || 'v2') as chunk_hash from stored where (doc_id + chunk_index) % 3 <> 0 union all select doc_id, max(chunk_index) + 1, sha256('end') from stored group by 1)"


def _fresh(chunks):
    kept = chunks.where("(doc_id + chunk_index) % 3 <> 0").select("doc_id", "chunk_index", F.sha2(F.concat("text", F.lit("v2")), 256).alias("chunk_hash"))
    return kept.unionAll(chunks.groupBy("doc_id").agg((F.max("chunk_index") + 1).alias("chunk_index"), F.sha2(F.lit("end"), 256).alias("chunk_hash")))


@query("c5_chunk_reconcile", STORE + _NEW + """
select coalesce(o.doc_id, n.doc_id) as doc_id, coalesce(o.chunk_index, n.chunk_index) as chunk_index, coalesce(n.chunk_hash, o.chunk_hash) as chunk_hash, n.doc_id is not null as is_active
from stored o full join fresh n on o.doc_id = n.doc_id and o.chunk_index = n.chunk_index""")
def c5(spark, d):
    chunks = stored(spark, d)
    return N.reconcile_chunks(chunks.select("doc_id", "chunk_index", "chunk_hash"), _fresh(chunks))


@query("c6_stale_embedding_delete", STORE + "select chunk_id from vectors where chunk_id not in (select chunk_id from stored where doc_id % 9 = 0)")
def c6(spark, d):
    chunks = stored(spark, d)
    return N.drop_stale_embeddings(vectors(chunks), chunks, docs(spark, d).where("doc_id % 9 = 0"))


@query("c7_missing_embeddings", STORE + "select chunk_id from stored where is_active and chunk_id not in (select chunk_id from vectors)")
def c7(spark, d):
    chunks = stored(spark, d)
    return N.missing_embeddings(chunks.select("chunk_id", "is_active"), vectors(chunks)).select("chunk_id")


@query("c8_dirty_mark", "select user_id as doc_id, arg_max(event_type, [epoch_us(ts)::varchar, event_type]) as reason, max(ts) as marked_at from events group by 1")
def c8(spark, d):
    return N.dirty_marks(table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("reason"), F.col("ts").alias("marked_at")))


@query("c9_batch_embed")
def c9(spark, d):
    from ..functions.models import embed_column, hash_embedder

    return chunk_documents(table(spark, d, "documents")).select("chunk_id", F.size(v := embed_column(hash_embedder())("text")).alias("dims"), v.alias("embedding"))


@query("d1_docs_by_source", "select source, count(*) as n from documents group by 1")
def d1(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("d2_active_chunks_by_source", STORE + "select source, count(*) as n from stored join docs using (doc_id) where is_active group by 1")
def d2(spark, d):
    per = stored(spark, d).where("is_active").groupBy("doc_id").agg(F.count("*").alias("n"))
    return per.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("n").alias("n"))


@query("d3_embeddings_by_source", STORE + "select source, count(*) as n from stored join docs using (doc_id) join vectors using (chunk_id) group by 1")
def d3(spark, d):
    chunks = stored(spark, d)
    per = chunks.join(vectors(chunks), "chunk_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))
    return per.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("n").alias("n"))


@query("d4_missing_embeddings_by_source", STORE + "select source, count(*) as n from stored s join docs using (doc_id) left join vectors v on s.chunk_id = v.chunk_id where is_active and v.chunk_id is null group by 1")
def d4(spark, d):
    chunks = stored(spark, d)
    per = N.missing_embeddings(chunks, vectors(chunks)).groupBy("doc_id").agg(F.count("*").alias("n"))
    return per.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("n").alias("n"))


@query("d5_source_summary", STORE + """
, per as (select s.doc_id, count(*) as chunks, count(v.chunk_id) as embedded from stored s left join vectors v using (chunk_id) where is_active group by 1)
select source, count(*) as docs, coalesce(sum(chunks), 0)::bigint as active_chunks, coalesce(sum(embedded), 0)::bigint as embedded_chunks, coalesce(sum(chunks - embedded), 0)::bigint as missing_embeddings,
  (count(*) - count(chunks))::bigint as docs_without_chunks from docs left join per using (doc_id) group by 1""")
def d5(spark, d):
    chunks = stored(spark, d)
    return A.source_summary(table(spark, d, "documents").select("doc_id", "source"), chunks, vectors(chunks))


@query("d6_docs_with_missing_embeddings", STORE + "select doc_id, source, url, title, count(*) as missing from stored s join docs using (doc_id) left join vectors v on s.chunk_id = v.chunk_id where is_active and v.chunk_id is null group by all")
def d6(spark, d):
    chunks = stored(spark, d)
    per = N.missing_embeddings(chunks, vectors(chunks)).groupBy("doc_id").agg(F.count("*").alias("missing"))
    return per.join(with_titles(table(spark, d, "documents")), "doc_id").select("doc_id", "source", "url", "title", "missing")


@query("d7_docs_with_no_active_chunks", STORE + "select doc_id, source from docs where coalesce(status, 1) = 1 and doc_id not in (select doc_id from stored where is_active)")
def d7(spark, d):
    return A.docs_without_chunks(docs(spark, d), stored(spark, d)).select("doc_id", "source")


@query("d8_audit_hashes", STORE + """
, broken as (select chunk_id, case when chunk_id % 13 = 0 then null else text end as text, case when chunk_id % 17 = 0 then null when chunk_id % 19 = 0 then sha256('x') else chunk_hash end as h from stored)
select 'chunk' as kind, chunk_id as id, case when text is null then 'missing_text' when h is null then 'missing_hash' else 'hash_mismatch' end as reason from broken where text is null or h is null or sha256(text) <> h""")
def d8(spark, d):
    c = F.col("chunk_id")
    digest = F.when(c % 17 == 0, F.lit(None)).when(c % 19 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("chunk_hash"))
    rows = stored(spark, d).select("chunk_id", F.when(c % 13 != 0, F.col("text")).alias("text"), digest.alias("h"))
    return A.hash_failures(rows, "chunk_id", "text", "h", "chunk")


@query("d9_audit_orphans", STORE + """
select 'chunk' as kind, chunk_id as id from stored where doc_id not in (select doc_id from docs where doc_id % 25 <> 1)
union all select 'embedding', chunk_id from vectors where chunk_id not in (select chunk_id from stored where chunk_index <> 2)""")
def d9(spark, d):
    chunks = stored(spark, d)
    gone = docs(spark, d).where("doc_id % 25 <> 1")
    no_doc = A.orphans(gone, chunks, vectors(chunks).limit(0)).where("kind = 'chunk'")
    return no_doc.unionAll(A.orphans(gone, chunks.where("chunk_index <> 2"), vectors(chunks)).where("kind = 'embedding'"))


@query("d10_audit_docs_no_chunks", STORE + "select doc_id from docs left join (select doc_id, chunk_id from stored where is_active) using (doc_id) group by 1 having count(chunk_id) = 0")
def d10(spark, d):
    return table(spark, d, "documents").join(stored(spark, d).where("is_active"), "doc_id", "left_anti").select("doc_id")


@query("d11_failure_summary", "select event_type as reason, count(*) as n from events group by 1")
def d11(spark, d):
    return A.failure_summary(table(spark, d, "events").withColumnRenamed("event_type", "reason"))


@query("d12_audit_index_vs_table", STORE + """
select chunk_id, 'index' as lacks from stored where is_active and chunk_id not in (select chunk_id from vectors)
union all select chunk_id, 'table' from vectors where chunk_id not in (select chunk_id from stored where is_active)""")
def d12(spark, d):
    chunks = stored(spark, d)
    return A.index_difference(vectors(chunks), chunks.where("is_active"))


@query("d13_repair")
def d13(spark, d):
    """Chunks rebuilt from the archived text of documents without active chunks, and chunks that then lack a vector."""
    chunks, documents = stored(spark, d), table(spark, d, "documents")
    broken = A.docs_without_chunks(docs(spark, d), chunks).select("doc_id")
    rebuilt = chunk_documents(documents.join(broken, "doc_id", "left_semi")).withColumn("is_active", F.lit(True))
    lacking = N.missing_embeddings(chunks.join(broken, "doc_id", "left_anti").unionByName(rebuilt), vectors(chunks))
    return lacking.select("chunk_id", "doc_id", "chunk_index")


@query("d16_version_baseline", STORE + """
, v as (select doc_id, source, 100 + doc_id % 600 as version_ord, doc_id % 97 as fetched, status from docs)
select source, max(version_ord) as version_ord, arg_max(doc_id, version_ord * 100000000000 + fetched * 100000000 + doc_id) as doc_id from v where version_ord <= 450 and coalesce(status, 1) = 1 group by 1""")
def d16(spark, d):
    v = docs(spark, d).where(A.active()).select("doc_id", "source", (100 + F.col("doc_id") % 600).alias("version_ord"), (F.col("doc_id") % 97).alias("fetched")).where("version_ord <= 450")
    return v.groupBy("source").agg(F.max("version_ord").alias("version_ord"), F.max_by("doc_id", F.struct("version_ord", "fetched", "doc_id")).alias("doc_id"))


@query("d17_pseudo_random_sample", CHUNKS + "select chunk_id from chunks where text_len between 500 and 2500 order by (chunk_id * 1103515245 + 42) % 2147483647, chunk_id limit 100")
def d17(spark, d):
    return A.sample_by_lcg(chunk_documents(table(spark, d, "documents")).where("text_len between 500 and 2500"), "chunk_id", 42, 100).select("chunk_id")


@query("d18_keyset_pages", CHUNKS + "select cast((row_number() over (order by chunk_id) - 1) // 500 as bigint) as page, chunk_id from chunks qualify true")
def d18(spark, d):
    """All keyset pages at once: a range partitioning gives each task a run of keys, whose places follow from the runs before it."""
    from ..sources.files import numbered

    return numbered(chunk_documents(table(spark, d, "documents")).select("chunk_id"), "chunk_id").select(F.floor(F.col("n") / 500).alias("page"), "chunk_id")


@query("d19_pipeline_meta", "select event_type as namespace, cast(user_id as varchar) as key, arg_max(value, [epoch_us(ts), event_id]) as value from events group by 1, 2")
def d19(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("namespace"), F.col("user_id").cast("string").alias("key")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


_TERMS = "regexp_extract_all(translate(lower({c}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\pL\\pN]+')"
POSTINGS = STORE + f""", titled as (select s.chunk_id, s.doc_id, d.title, s.text from stored s join docs d using (doc_id) where is_active and coalesce(status, 1) = 1),
words as (select chunk_id, doc_id, 'title' as field, unnest({_TERMS.format(c='title')}) as term from titled union all select chunk_id, doc_id, 'text', unnest({_TERMS.format(c='text')}) from titled)
"""


def titled(spark, d, hits=None):
    """Active chunks of active documents, with title and source taken along; with hits (chunk_id, checkpointed) only documents that have some are chunked."""
    rows = docs(spark, d).where(A.active())
    if hits is not None:
        ids = hits.select(F.floor(F.col("chunk_id") / 1_000_000).alias("doc_id")).distinct()
        rows = rows.join(few(ids, ids.count()), "doc_id", "left_semi")
    return stored(spark, d, rows, ("title", "source")).where("is_active").select("chunk_id", "doc_id", "chunk_index", "title", "text", "source")


@query("e1_fts_rebuild", POSTINGS + "select term, chunk_id, field, count(*)::int as tf from words group by 1, 2, 3")
def e1(spark, d):
    return I.postings(titled(spark, d)).select("term", "chunk_id", "field", "tf")


@query("e2_fts_sync", POSTINGS + "select term, chunk_id, count(*) as tf from words group by 1, 2")
def e2(spark, d):
    """An index that is out of date for some documents, synchronised: equal to a rebuilt one."""
    rows = titled(spark, d)
    old = rows.withColumn("text", F.when(F.col("doc_id") % 6 == 0, F.lit("out of date")).otherwise(F.col("text")))
    terms = lambda r: r.select("doc_id", "chunk_id", F.explode(F.concat(I.index_terms(F.col("title")), I.index_terms(F.col("text")))).alias("term"))
    dirty = table(spark, d, "documents").where("doc_id % 6 = 0").select("doc_id")
    return sync(terms(old), dirty, terms(rows)).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


@query("e3_parent_map_rebuild", CHUNKS + "select doc_id, chunk_index // 12 as parent_index, min(chunk_index) as start_chunk_index, max(chunk_index) as end_chunk_index, doc_id * 1000000 + chunk_index // 12 as parent_id from chunks group by 1, 2")
def e3(spark, d):
    return parents(chunk_documents(table(spark, d, "documents")))


@query("e4_parent_sync", CHUNKS + "select chunk_id, doc_id * 1000000 + chunk_index // 12 as parent_id from chunks")
def e4(spark, d):
    chunks = chunk_documents(table(spark, d, "documents"))
    keyed = lambda n: parent_map(chunks, n).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    old = keyed(12).withColumn("parent_id", F.when(F.col("doc_id") % 5 == 0, F.col("parent_id") + 1).otherwise(F.col("parent_id")))
    return sync(old, table(spark, d, "documents").where("doc_id % 5 = 0"), keyed(12)).select("chunk_id", "parent_id")


VEC = "with e as (select vec_id as chunk_id, embedding::double[] as v, label from embeddings), f as (select chunk_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from e)"


def vecs(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


@query("e5_dense_index_flat", VEC + " select chunk_id, round(v[1], 6) as first, round(v[64], 6) as last, round(list_dot_product(v, v), 6) as norm from f")
def e5(spark, d):
    v = F.col("embedding")
    return I.flat_index(vecs(spark, d)).select("chunk_id", F.round(v[0], 6).alias("first"), F.round(v[63], 6).alias("last"), F.round(I.dot(v, v), 6).alias("norm"))


QUANT = VEC + """, x as (select chunk_id, unnest(v) as x, generate_subscripts(v, 1) as dim from f), s as (select dim, min(x) as lo, max(x) as hi from x group by 1),
c as (select chunk_id, dim, lo, hi, case when hi > lo then floor((x - lo) / (hi - lo) * 15 + 0.5)::int else 0 end as code from x join s using (dim))"""


@query("e8_quantised_index", QUANT + " select chunk_id, string_agg(code::varchar, ' ' order by dim) as codes from c group by 1")
def e8(spark, d):
    return I.quantise(I.flat_index(vecs(spark, d))).select("chunk_id", F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"))


SPARSE = POSTINGS + """, hashed as (select chunk_id, cast(('0x' || substr(md5(term), 1, 8))::bigint % 4096 as int) as term_id, count(*) as tf from words group by 1, 2),
sparse as (select term_id, chunk_id, ln(1 + tf) as weight from hashed qualify row_number() over (partition by chunk_id order by tf desc, term_id) <= 256)"""


@query("e9_sparse_index", SPARSE + " select term_id, chunk_id, round(weight, 6) as weight from sparse")
def e9(spark, d):
    return I.sparse_index(titled(spark, d)).select("term_id", "chunk_id", F.round("weight", 6).alias("weight"))


@query("k4_watermarked_index_build", STORE + """, wm as (select max(doc_id) // 2 * 1000000 as w from docs)
select chunk_id, 'new' as shard from stored, wm where chunk_id > w union all select chunk_id, 'reactivated' from stored, wm where chunk_id <= w and doc_id % 8 = 0""")
def k4(spark, d):
    chunks = stored(spark, d).select("chunk_id", "doc_id")
    top = table(spark, d, "documents").agg(F.max("doc_id")).first()[0] or 0
    return I.after_watermark(chunks, top // 2 * 1000000, table(spark, d, "documents").where("doc_id % 8 = 0")).select("chunk_id", "shard")


@query("b12_compression_stats")
def b12(spark, d):
    from ..sources.files import zstd

    raw = F.octet_length(F.encode("text", "utf-8"))
    rows = table(spark, d, "documents").select("source", raw.alias("raw"), F.octet_length(zstd(F.encode("text", "utf-8"))).alias("packed"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.avg("raw").alias("avg_raw"), F.avg("packed").alias("avg_packed"), (F.sum("raw") / F.sum("packed")).alias("ratio"))


@query("p3_graph_source_scan", STORE + "select chunk_id, doc_id, chunk_index from stored join docs using (doc_id) where source = 'src0' and is_active")
def p3(spark, d):
    return stored(spark, d, table(spark, d, "documents").where("source = 'src0'")).where("is_active").select("chunk_id", "doc_id", "chunk_index")
