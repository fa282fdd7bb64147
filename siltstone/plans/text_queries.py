"""Queries of the text functions, the page sources and question understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions import text as X
from ..operators.chunking import chunk_documents, with_titles
from ..sources.html import extract_links, html_to_text
from ..operators.retrieval import resolve_titles
from .registry import query, table
from .sql import CHUNKS, DOCS, DOCS_CTE, QUESTIONS, marker_sql, squeeze_sql, trim_sql


def _docs(spark, d):
    return with_titles(table(spark, d, "documents"))


def questions(spark, d):
    """The benchmark's passages turned into questions of twelve forms."""
    w = F.split("text", " ")
    a, b = F.regexp_replace(F.get(w, 0), "[^a-zA-Z]", ""), F.regexp_replace(F.get(w, 2), "[^a-zA-Z]", "")
    forms = [
        ("Who is ", a, " ", b, "?"), ("Where is the ", a, " of ", b, "?"), ("What is ", a, "'s best build?"), ("What is the latest version of ", a, "?"),
        ("How does ", a, " work with ", b, "?"), ("What is ", a, " ", b, "?"), ("Tell the story of ", a, " before ", b, " left whose home it was"),
        ("Which weapon should ", a, " use?"), ("What is the damage value of the ", a, " skill at level 9?"), ("Compare ", a, " and ", b, " and say what the difference is now?"),
        ("summarize everything about ", a), (a, " ", b, " crit"),
    ]
    q = F.lit("")
    for k, f in enumerate(forms):
        q = F.when(F.col("item_id") % 12 == k, F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in f])).otherwise(q)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), q.alias("question"))


@query("a4_extract_links", """
select page_id, count(*) as n_links, string_agg(u, ' ' order by u) as links from (
  select page_id, regexp_replace(case when h like 'http%' then h else regexp_extract(url, '^https?://[^/?#]+') || h end, '#.*$', '') as u
  from (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as h from pages))
group by 1""")
def a4(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(extract_links("html", "url")).alias("u"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_links"), F.array_join(F.array_sort(F.collect_list("u")), " ").alias("links"))


HTML_SQL = squeeze_sql("replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')")


@query("a5_html_plain_text", f"select page_id, {HTML_SQL} as text from pages")
def a5(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_plain_text(F.col("html")).alias("text"))


@query("a5_html_to_markdown")
def a5m(spark, d):
    return table(spark, d, "pages").select("page_id", html_to_text("html").alias("text"))


@query("a6_page_quality_gate", f"""
with t as (select page_id, lower({HTML_SQL}) as t from pages)
select page_id, case when length(t) < 800 then 'short'
  when {' + '.join(f"cast(contains(t, '{p}') as int)" for p in X.BAD_PAGE_PHRASES)} >= 3 then 'phrases'
  when contains(t, 'create your free account today') and contains(t, 'article watchlist') then 'account' end as problem
from t""")
def a6(spark, d):
    return table(spark, d, "pages").select("page_id", X.page_quality_problem(X.html_plain_text(F.col("html"))).alias("problem"))


HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1)), '^www\\.', '')"


@query("a12_url_policy", f"""
select page_id, regexp_replace(url, '#.*$', '') as url, {HOST} as host,
  regexp_extract(url, '[?&]lang=([^&#]*)', 1) in ('', 'EN', 'en', 'En', 'eN') as lang_ok,
  {HOST} = 'example.com' or suffix({HOST}, '.example.com') as host_ok,
  regexp_matches(url, '^https?://') and ({HOST} = 'example.com' or suffix({HOST}, '.example.com')) and starts_with(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/en/') as allowed
from pages""")
def a12(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", X.url_normalize(u).alias("url"), X.url_host(u).alias("host"), X.allow_lang(u).alias("lang_ok"),
        X.host_matches(u, "example.com").alias("host_ok"), X.is_allowed_url(u, ["example.com"], ["/en/"]).alias("allowed"),
    )


@query("a13_url_filter", "select page_id, url from pages where not regexp_matches(url, '(?i)(?:/fr/)|(?:\\?page=1)') and regexp_matches(url, '(?i)(?:example\\.(com|org))')")
def a13(spark, d):
    deny, allow = X.merge_patterns("/fr/", r"\?page=1"), X.merge_patterns(r"example\.(com|org)")
    return table(spark, d, "pages").where(X.url_filter(F.col("url"), deny, allow)).select("page_id", "url")


_NORMAL = r"regexp_replace(regexp_replace(nfc_normalize(text), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"


@query("b1_normalize_text", f"select doc_id, {trim_sql(_NORMAL)} as text from documents")
def b1(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("text"))


@query("b2_chunk_text", CHUNKS + "select chunk_id, doc_id, chunk_index, text, text_len, chunk_hash from chunks")
def b2(spark, d):
    return chunk_documents(table(spark, d, "documents"))


_steps = "html"
for _p, _to in (("\u00a0", " "), ("\u200b", "")):
    _steps = f"replace({_steps}, '{_p}', '{_to}')"
for _p, _to in X.WIKI_STEPS:
    _to = "\\1" if _to == "$1" else _to
    _to = "chr(10)" if _to == "\n" else f"'{_to}'"
    _steps = f"regexp_replace({_steps}, '{_p}', {_to}, 'g')"


@query("b3_clean_wiki_text", f"""
with t as (select page_id, {_steps} as t from pages),
l as (select page_id, list_transform(string_split(t, chr(10)), lambda x: {trim_sql('x')}) as l from t)
select page_id, {trim_sql(f'''regexp_replace(array_to_string(list_filter(l, lambda x: x = '' or not (
  regexp_matches(x, '{X.DROPPED_LINES}') or regexp_matches(x, '{X.MENU_LINES}') or (regexp_matches(x, '{X.ICON_LINES}') and length(x) < 80)
  or (regexp_matches(x, '^\\|.*\\|$') and length(x) < 120)
  or (length(x) > 30 and length(x) - length(regexp_replace(x, '[%?=&/:.#_+|\\[\\]()]', '', 'g')) > 0.6 * length(x)))), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')''')} as text
from l""")
def b3(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_wiki_text(F.col("html")).alias("text"))


def _defang_sql(c):
    out = f"case when len(list_filter(string_split({c}, chr(10)), lambda x: contains(x, '|'))) > 10 or length({c}) - length(replace({c}, '|', '')) > 80 then replace({c}, '|', ' ') else {c} end"
    for left, right, most in (("[[", "]]", 20), ("{{", "}}", 10)):
        n = lambda w: f"(length({c}) - length(replace({c}, '{w}', ''))) / 2"  # noqa: B023, E731
        out = f"case when {n(left)} > {most} or {n(right)} > {most} then replace(replace({out}, '{left}', ' '), '{right}', ' ') else {out} end"
    return out


@query("b4_defang_tables", f"select doc_id, {_defang_sql('text')} as text from documents")
def b4(spark, d):
    return table(spark, d, "documents").select("doc_id", X.defang_tables(F.col("text")).alias("text"))


@query("b5_clean_training_text", "select doc_id, " + squeeze_sql("regexp_replace(regexp_replace(text, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g')") + " as text from documents")
def b5(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_training_text(F.col("text")).alias("text"))


@query("b6_hashes", """
select doc_id, sha256(text) as raw_hash, sha256('{"lang":"' || lang || '","source":"' || source || '"}') as meta_hash,
  'qa_' || doc_id || '_' || substr(sha256(text), 1, 12) as record_id from documents""")
def b6(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.sha2("text", 256).alias("raw_hash"), X.stable_json_hash(F.col("lang"), F.col("source")).alias("meta_hash"), X.record_id("qa", F.col("doc_id"), F.col("text")).alias("record_id")
    )


def _versions_sql(c):
    p = r"'(?i)\b(?:version\s*)?v?(\d{1,2})\.(\d{1,2})\b'"
    z = f"list_zip(regexp_extract_all({c}, {p}, 1), regexp_extract_all({c}, {p}, 2))"
    return f"list_filter(list_transform({z}, lambda x: [cast(x[1] as int), cast(x[2] as int)]), lambda v: v[1] between 1 and 6 and v[2] <= 9)"


@query("b7_version_signal", DOCS + f"""
, v as (select doc_id, {_versions_sql('title')} as t, {_versions_sql('substr(text, 1, 800)')} as e, {_versions_sql('substr(text, 1, 3000)')} as b, source from docs),
best as (select doc_id, coalesce(list_max(t), list_max(e), case when source = 'src0' or len(list_distinct(b)) = 1 then list_max(b) end) as x from v)
select doc_id, x[1] || '.' || x[2] as version_label, x[1] * 100 + x[2] as version_ord from best""")
def b7(spark, d):
    v = X.version_signal(F.col("title"), F.col("text"), F.col("source") == "src0")
    return _docs(spark, d).select("doc_id", v.alias("v")).select("doc_id", F.col("v.label").alias("version_label"), F.col("v.ord").alias("version_ord"))


@query("b8_chunk_deny_filter", CHUNKS + "select chunk_id, chunk_index from chunks where not regexp_matches(text, '(?i)(?:idiot|scum)|(?:all rights reserved)')")
def b8(spark, d):
    deny = X.merge_patterns("idiot|scum", "all rights reserved")
    return chunk_documents(table(spark, d, "documents"), keep=~F.col("text").rlike(f"(?i){deny}")).select("chunk_id", "chunk_index")


@query("b9_min_length_gate", f"select doc_id from documents where length({trim_sql('text')}) >= case when source = 'src1' then 800 else 100 end")
def b9(spark, d):
    return table(spark, d, "documents").where(F.length(X.trim_all(F.col("text"))) >= F.when(F.col("source") == "src1", 800).otherwise(100)).select("doc_id")


@query("b10_embed_prompt", DOCS + "select doc_id, case when starts_with(text, 'passage: ') then text else 'passage: ' || text end as by_prefix, 'title: ' || title || ' | text: ' || text as by_template from docs where not starts_with(text, 'title: ')")
def b10(spark, d):
    c = F.col("text")
    return _docs(spark, d).where(~F.startswith(c, F.lit("title: "))).select(
        "doc_id", X.embed_prompt(c, "passage: ").alias("by_prefix"), X.embed_prompt(c, "", "title: {title} | text: {text}", F.col("title")).alias("by_template")
    )


@query("b11_truncate_for_embedding", f"with t as (select doc_id, substr(text, 1, 450) as t from documents) select doc_id, {_defang_sql('t')} as text from t")
def b11(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 450).alias("t")).select("doc_id", X.defang_tables(F.col("t")).alias("text"))


@query("b13_quality_flags", CHUNKS + ', ' + DOCS_CTE + f"""
select chunk_id, length(c.text) >= 350 and not ({' or '.join(f"contains(lower(c.text), '{m}') or contains(lower(title), '{m}')" for m in X.BAD_CHUNK_MARKERS)}) as good,
  length(c.text) > 220 or regexp_matches(lower(c.text), '{'|'.join(f'(?:{p})' for p in X.LOW_VALUE_QUESTION)}') as low_value,
  {' or '.join("contains(lower(c.text), '" + m.replace("'", "''") + "')" for m in X.REFUSALS)} as refusal,
  {' or '.join(f"contains(lower(c.text), '{m}')" for m in X.ANSWER_ARTEFACTS)} or regexp_matches(lower({trim_sql('c.text')}), '^answer:') as artefact
from chunks c join docs using (doc_id)""")
def b13(spark, d):
    docs = table(spark, d, "documents")
    c = chunk_documents(docs).join(with_titles(docs).select("doc_id", "title"), "doc_id")
    t = F.col("text")
    return c.select("chunk_id", X.is_good_chunk(t, F.col("title")).alias("good"), X.is_low_value_question(t).alias("low_value"), X.is_refusal(t).alias("refusal"), X.has_answer_artefact(t).alias("artefact"))


@query("b14_tokenize", """
select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_'']+'))), ' ') as terms,
  array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ') as ltr_terms from documents""")
def b14(spark, d):
    joined = lambda a: F.array_join(F.array_sort(a), " ")
    return table(spark, d, "documents").select("doc_id", joined(X.tokenize(F.col("text"))).alias("terms"), joined(X.ltr_terms(F.col("text"))).alias("ltr_terms"))


@query("b15_keys", DOCS + f"""
select doc_id, trim(regexp_replace(lower(replace(title, '’', '''')), '[^a-z0-9]+', ' ', 'g')) as title_key,
  {trim_sql("regexp_split_to_array(title, '\\s*[|｜]\\s*')[1]")} as primary_title, {squeeze_sql('lower(title)')} as match_key,
  trim(regexp_replace({squeeze_sql('lower(title)')}, '[^\\pL\\pN\\s]', ' ', 'g')) as entity_key from docs""")
def b15(spark, d):
    t = F.col("title")
    return _docs(spark, d).select("doc_id", X.title_key(t).alias("title_key"), X.primary_title(t).alias("primary_title"), X.match_key(t).alias("match_key"), X.entity_key(t).alias("entity_key"))


_ANSWER = """'<think>about ' || item_id || '</think>' || case item_id % 4 when 0 then '```json' || chr(10) || '["first ' || item_id || '", "FIRST ' || item_id || '", "tiny", "a   second one"]' || chr(10) || '```'
  when 1 then 'Sure: ["only ' || item_id || '"] done' when 2 then 'no list' else '["broken' end"""


@query("b16_parse_model_lists", f"""
with a as (select item_id, {_ANSWER} as answer from benchmark),
j as (select item_id, nullif(regexp_extract(regexp_replace(regexp_replace(answer, '(?is)<think>.*?</think>', '', 'g'), '```(json)?', '', 'g'), '(?s)\\[.*\\]'), '') as j from a),
i as (select item_id, unnest(case when json_valid(j) then from_json(j, '["VARCHAR"]') else [] end) as x, generate_subscripts(case when json_valid(j) then from_json(j, '["VARCHAR"]') else [] end, 1) as n from j),
s as (select item_id, n, {squeeze_sql('x')} as x from i),
f as (select *, row_number() over (partition by item_id, lower(x) order by n) as k from s where length(x) between 5 and 300)
select a.item_id, coalesce((select string_agg(x, '|' order by n) from f where f.item_id = a.item_id and k = 1), '') as items from a""")
def b16(spark, d):
    answer = F.expr(_ANSWER.replace("chr(10)", "'\\n'").replace("|| item_id ||", "|| cast(item_id as string) ||"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.json_strings(answer), "|").alias("items"))


_TOKENS = """list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9_'']+'), lambda x: regexp_replace(regexp_replace(x, '''s$', ''), '^''+|''+$', '', 'g')),
  lambda x: length(x) >= 2 and not list_contains([""" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "], x))"


@query("f5_fts_query_build", f"""
with q as (select query_id, question as text from ({QUESTIONS}) union all select -1 - item_id, text from benchmark), t as (select query_id, {_TOKENS} as w from q),
p as (select query_id, list_concat(case when len(w) between 1 and 4 then [array_to_string(w, ' ')] else [] end, w) as p from t),
u as (select query_id, unnest(p) as x, generate_subscripts(p, 1) as n from p), f as (select query_id, x, min(n) as n from u group by 1, 2)
select p.query_id, coalesce((select string_agg('"' || x || '"', ' OR ' order by n) from f where f.query_id = p.query_id), '') as fts_query from p""")
def f5(spark, d):
    q = questions(spark, d).unionAll(table(spark, d, "benchmark").select(-1 - F.col("item_id"), "text"))
    return q.select("query_id", X.lexical_query(F.col("question")).alias("fts_query"))


V = Q.DEFAULT
_LOW = "lower(question)"
_REC = f"""({marker_sql(_LOW, V.recommended)} or regexp_matches({_LOW}, '\\bshould\\s+[a-z][a-z'' -]{{1,40}}?\\s+(use|equip|run|build)\\b')
  or regexp_matches({_LOW}, '\\b(stats|teams?|weapons?)\\s+for\\s+') or regexp_matches({_LOW}, '\\b[a-z][a-z'' -]{{1,40}}?''s\\s+(best\\s+|recommended\\s+)?(stats|teams?|weapons?)\\b'))"""
_TALENT = f"(regexp_matches({_LOW}, '{V.values}') and regexp_matches({_LOW}, '{V.talents}') and regexp_matches({_LOW}, '\\b(level|lv\\.?)\\s*\\d+\\b'))"
_CURRENT = f"regexp_matches({squeeze_sql('question')}, '{Q.CURRENT}')"


def _entity_sql(c, patterns):
    got = "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, '{p.replace(chr(39), chr(39) * 2)}', 1), '')" for p in patterns) + ")"
    return f"nullif(regexp_replace(regexp_replace({squeeze_sql(got)}, '^[''\\s]+|[''\\s]+$', '', 'g'), '(?i)^the\\s+', ''), '')"


_LOOKUP = f"case when not {_CURRENT} then {_entity_sql('question', Q.LOOKUP)} end"
_BUILD = _entity_sql(squeeze_sql("question"), Q.BUILD)
_SUB = "list_filter([" + ", ".join(f"case when {marker_sql(_LOW, m)} then '{k}' end" for k, m in sorted(V.subtypes.items())) + "], lambda x: x is not null)"
_INTENT = f"""case when {_CURRENT} then 'version' when {marker_sql(_LOW, V.biography)} then 'biography' when {marker_sql(_LOW, V.location)} then 'location'
  when {_BUILD} is not null or len({_SUB}) > 0 or {_REC} then 'build' when {_TALENT} or {marker_sql(_LOW, V.mechanic)} then 'mechanic'
  when {marker_sql(_LOW, V.build)} then 'build' when {_LOOKUP} is not null then 'lookup' when {marker_sql(_LOW, V.lore)} then 'lore' else 'general' end"""


@query("h1_detect_intent", f"select query_id, question, {_INTENT} as intent from ({QUESTIONS})")
def h1(spark, d):
    return questions(spark, d).select("query_id", "question", Q.detect_intent(F.col("question")).alias("intent"))


@query("h2_marker_in_text", f"select conv_id, turn, {marker_sql('lower(text)', V.lore)} as lore, {marker_sql('lower(text)', ('is', 'that the'))} as common from conversations")
def h2(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", Q.has_marker(t, V.lore).alias("lore"), Q.has_marker(t, ("is", "that the")).alias("common"))


@query("h3_build_subtypes", f"select query_id, array_to_string({_SUB}, ',') as subtypes from ({QUESTIONS})")
def h3(spark, d):
    return questions(spark, d).select("query_id", F.array_join(Q.build_subtypes(F.col("question")), ",").alias("subtypes"))


@query("h4_question_flags", f"""
select query_id, regexp_matches({_LOW}, '{'|'.join(V.broad)}') as broad, regexp_matches({_LOW}, '{'|'.join(V.recency)}') as recency, {_CURRENT} as current_version,
  {_TALENT} as talent_value, {_REC} as build_recommendation from ({QUESTIONS})""")
def h4(spark, d):
    q = F.col("question")
    return questions(spark, d).select(
        "query_id", Q.is_broad(q).alias("broad"), Q.is_recency_sensitive(q).alias("recency"), Q.is_current_version(q).alias("current_version"),
        Q.is_talent_value(q).alias("talent_value"), Q.is_build_recommendation(q).alias("build_recommendation"),
    )


@query("h5_entities", f"""
select query_id, {_LOOKUP} as lookup_entity, {_BUILD} as build_entity, nullif(trim(regexp_extract(question, '(?i)\\b([a-z][a-z -]{{1,40}}?)''s\\s', 1)), '') as possessive_entity from ({QUESTIONS})""")
def h5(spark, d):
    q = F.col("question")
    return questions(spark, d).select("query_id", Q.lookup_entity(q).alias("lookup_entity"), Q.build_entity(q).alias("build_entity"), Q.possessive_entity(q).alias("possessive_entity"))


@query("h6_resolve_entity")
def h6(spark, d):
    """The title closest to each entity, if it is close enough, over whole titles."""
    entities = questions(spark, d).select("query_id", Q.lookup_entity(F.col("question")).alias("entity"))
    return resolve_titles(entities, _docs(spark, d).select(X.primary_title(F.col("title")).alias("title")))


@query("g8_gates", f"""
with q as (select *, len(regexp_extract_all(question, '\\w+')) as n from ({QUESTIONS}))
select query_id, n >= 8 and (length(question) - length(replace(question, '?', '')) > 1 or regexp_matches({_LOW}, '\\b(compare|difference|relationship|versus|vs|and|while|whereas)\\b')) as decompose,
  n >= 7 and regexp_matches({_LOW}, '\\b(before|after|caused|connected|led to|related to|relationship|same .+ as|through which|whose)\\b') as multi_hop from q""")
def g8(spark, d):
    q = F.col("question")
    return questions(spark, d).select("query_id", Q.should_decompose(q).alias("decompose"), Q.should_hop(q).alias("multi_hop"))


@query("f6_fts_intent_query", f"""
with q as (select query_id, {_INTENT} as intent, {_LOOKUP} as lookup, {_BUILD} as build, question from ({QUESTIONS}))
select query_id, case intent when 'lookup' then 'title:"' || lower(lookup) || '"'
  when 'build' then '(title:"' || lower(coalesce(build, lookup)) || '" OR text:"' || lower(coalesce(build, lookup)) || '") AND ({' OR '.join(f'"{m}"' for m in sorted(V.build))})' end as fts_query from q""")
def f6(spark, d):
    return questions(spark, d).select("query_id", Q.intent_lexical_query(F.col("question")).alias("fts_query"))


@query("e11_model_name", """
with m as (select page_id, case page_id % 3 when 0 then url when 1 then 'Org\\' || page_id || ':latest' else ' Big/Model-' || page_id end as name from pages),
p as (select page_id, regexp_replace(replace(lower(trim(name)), '\\', '/'), ':latest$', '') as p from m)
select page_id, case when length(p) - length(replace(p, '/', '')) > 1 then string_split(p, '/')[-1] else p end as model from p""")
def e11(spark, d):
    name = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("Org\\"), F.col("page_id").cast("string"), F.lit(":latest")))
    return table(spark, d, "pages").select("page_id", X.model_name(name.otherwise(F.concat(F.lit(" Big/Model-"), F.col("page_id").cast("string")))).alias("model"))


@query("p5_article_url", f"select page_id, regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '^/[a-z]{{2}}/[0-9]+$') as article, suffix({HOST}, '.org') as org from pages")
def p5(spark, d):
    path = F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", path.rlike(r"^/[a-z]{2}/[0-9]+$").alias("article"), F.endswith(X.url_host(F.col("url")), F.lit(".org")).alias("org"))


@query("p6_text_fallback", f"select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {trim_sql('x')}), lambda x: x <> ''), chr(10)) as text from documents")
def p6(spark, d):
    return table(spark, d, "documents").select("doc_id", X.text_fallback(F.col("text")).alias("text"))


@query("p7_normalize_query", f"select item_id, {squeeze_sql('text')} as query from benchmark")
def p7(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.squeeze(F.col("text")).alias("query"))
