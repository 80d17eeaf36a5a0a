"""Queries over the driver's tables, each beside its DuckDB SQL (none where SQL can't say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import columns as C
from docloom.functions.tables import CONFIDENCE_BY_KIND, KIND_BY_EXTENSION, PROCESSOR_BY_KIND, STOP_WORDS
from docloom.operators import graph as G
from docloom.operators import notes as N
from docloom.operators import retrieval as R
from docloom.operators import state as S
from docloom.operators import tables as T
from docloom.operators import text as X
from docloom.runtime import fresh_path, importable, spread, table
from docloom.sources.files import classify
from docloom.streaming import watch as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

QUERY_TEXT = "the anatble ananan"
LINK_THRESHOLD = 0.35


def query(sql: str | None = None, name: str | None = None) -> Callable[[Callable], Callable]:
    """Register fn(t) where t(name) reads a table of the query's folder."""

    def add(fn: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            read = lambda what: table(spark, sf_dir, what)
            read.spark, read.dir = spark, sf_dir
            return fn(read)

        key = name or fn.__name__
        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return fn

    return add


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ------------------------------------------------------------------ retrieval

_CORPUS = "corpus as (select 'doc-' || doc_id as id, doc_id as seq, doc_id, text, lang, source, embedding from documents left join embeddings on vec_id = doc_id), q as (select cast(embedding as double[]) as v from embeddings where vec_id = 0)"
_COS = "list_dot_product(cast(embedding as double[]), v) / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[])) * list_dot_product(v, v))"


def _dense_sql(pool: int | None, least: float = 0.0, where: str = "") -> str:
    return f"select *, row_number() over (order by score desc, id) as rank from (select * from (select id, seq, {_COS} as score from corpus, q where embedding is not null {where}) where score >= {least} order by score desc, id {f'limit {pool}' if pool else ''})"


def _bm25_sql(text: str, pool: int) -> str:
    terms = R.query_terms(text)
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""select *, row_number() over (order by score desc, seq) as rank from (
      select id, seq, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
      from (select id, seq, dl, term, len(list_filter(w, lambda x: x = term)) as tf from toks, (values {values}) as terms(term)) p
      join (select term, count(*) filter (where list_contains(w, term)) as df from toks, (values {values}) as terms(term) group by term) using (term),
      (select count(*) as n, avg(dl) as avgdl from toks)
      where tf > 0 group by id, seq order by score desc, seq limit {pool})"""


_TOKS = "toks as (select id, seq, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') as w, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) as dl from corpus)"


def _corpus(t) -> R.Corpus:
    return R.corpus_of(t("documents"), t("embeddings"))


def _vector(t, at: int = 0) -> list[float]:
    return [float(x) for x in t("embeddings").where(F.col("vec_id") == at).first()["embedding"]]


def _store(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), "embedding", "label")


_STORE = "corpus as (select vec_id as id, vec_id as seq, embedding, label from embeddings), q as (select cast(embedding as double[]) as v from embeddings where vec_id = 0)"


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_STORE} select id, round(score, 6) as score, rank from ({_dense_sql(10)})")
def dense_topk(t):
    return _ranked(R.dense_search(_store(t), _vector(t), 10))


@query(f"with {_STORE} select id, round(score, 6) as score, rank from ({_dense_sql(50, 0.2)})")
def dense_min_score(t):
    return _ranked(R.dense_search(_store(t), _vector(t), 50, 0.2))


@query(f"with {_STORE} select id, round(score, 6) as score, rank from ({_dense_sql(10, 0.0, 'and label = 3')})")
def dense_filtered(t):
    return _ranked(R.dense_search(_store(t), _vector(t), 10, 0.0, {"label": 3}))


@query(f"with {_STORE} select id, round(score, 6) as score, rank from ({_dense_sql(None, -1.0)})")
def dense_negative_scores(t):
    return _ranked(R.dense_all(_store(t), _vector(t), -1.0))


@query(f"""with q as (select cast(embedding as double[]) as v from embeddings where vec_id = 0),
  corpus as (select vec_id as id, cast(embedding as double[]) as e from embeddings union all select -1, list_transform(range(64), lambda x: 0.0) union all select -2, [1.0::double]),
  s as (select id, case when len(e) = 64 and list_dot_product(case when len(e) = 64 then e else v end, case when len(e) = 64 then e else v end) > 0 and len(list_filter(e, lambda x: x <> 0)) > 0
    then list_dot_product(case when len(e) = 64 then e else v end, v) / sqrt(list_dot_product(case when len(e) = 64 then e else v end, case when len(e) = 64 then e else v end) * list_dot_product(v, v)) else 0.0 end as score from corpus, q)
  select id, round(score, 6) as score from s where score >= 0""")
def dense_zero_and_dim_mismatch(t):
    odd = t.spark.createDataFrame([(-1, [0.0] * 64), (-2, [1.0])], "id long, embedding array<float>")
    rows = _store(t).select("id", "embedding").unionByName(odd).withColumn("score", R.query_score(F.col("embedding"), _vector(t)))
    return rows.where("score >= 0").select("id", r6("score").alias("score"))


@query("""with q as (select vec_id as query, cast(embedding as double[]) as v from embeddings where vec_id % 20 = 0),
  s as (select query, vec_id as id, list_dot_product(cast(embedding as double[]), v) / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[])) * list_dot_product(v, v)) as score from embeddings, q),
  r as (select *, row_number() over (partition by query order by score desc, id) as rank from s where score >= 0)
  select query, id, round(score, 6) as score, rank from r where rank <= 3""")
def dense_batch_top3(t):
    asks = t("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return R.dense_batch(_store(t), asks, 3).select("query", "id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_CORPUS}, {_TOKS} select id, round(score, 6) as score, rank from ({_bm25_sql(QUERY_TEXT, 10)})")
def bm25_topk(t):
    return _ranked(R.bm25_search(_corpus(t), QUERY_TEXT, 10))


@query(f"with {_CORPUS}, {_TOKS} select id, round(score, 6) as score, rank from ({_bm25_sql('anatble anatble ananan', 10)})")
def bm25_repeated_terms(t):
    return _ranked(R.bm25_search(_corpus(t), "anatble anatble ananan", 10))


@query("with w as (select len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) as dl from documents) select count(*) as n_docs, cast(sum(dl) as bigint) as n_words, round(avg(dl), 6) as avg_dl from w")
def bm25_corpus_stats(t):
    return R.bm25_statistics(t("documents")).select("n_docs", "n_words", r6("avg_dl").alias("avg_dl"))


@query("with w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from documents) select term, count(*) as df from w group by term order by df desc, term limit 50")
def bm25_df_top50(t):
    pairs = t("documents").select(F.explode(F.array_distinct(C.tokens("text"))).alias("term"))
    return pairs.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(50)


_LEGS = [("a", [("b", 1), ("a", 2), ("c", 3)]), ("b", [("a", 1), ("b", 2), ("a", 3)])]


@query("select id, round(sum(1.0 / (60 + rank)), 6) as rrf from (values ('b', 1), ('a', 2), ('c', 3), ('a', 1), ('b', 2), ('a', 3)) as legs(id, rank) group by id")
def rrf_fuse(t):
    legs = [t.spark.createDataFrame(rows, "id string, rank int") for _, rows in _LEGS]
    return R.rrf(legs).select("id", r6("rrf").alias("rrf"))


def _hybrid_sql(dense: bool = True, lexical: bool = True, least: float = 0.0, where: str = "", k: int = 10) -> str:
    parts = ([f"select id, rank from ({_dense_sql(50)})"] if dense else []) + ([f"select id, rank from ({_bm25_sql(QUERY_TEXT, 50)})"] if lexical else [])
    return f"""with {_CORPUS}, {_TOKS}, fused as (select id, sum(1.0 / (60 + rank)) as rrf from ({' union all '.join(parts)}) group by id),
      top as (select *, row_number() over (order by rrf desc, id) as rank from (select * from fused where rrf >= {least} order by rrf desc, id limit {k}))
      select id, source, lang, round(rrf, 6) as rrf, rank from top join corpus using (id) {where}"""


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("id", "source", "lang", r6("rrf").alias("rrf"), F.col("rank").cast("long").alias("rank"))


@query(_hybrid_sql())
def hybrid_search(t):
    return _shown(R.hybrid_search(_corpus(t), QUERY_TEXT, _vector(t)))


@query(_hybrid_sql(least=0.0145))
def hybrid_min_score(t):
    return _shown(R.hybrid_search(_corpus(t), QUERY_TEXT, _vector(t), min_score=0.0145))


@query(_hybrid_sql(where="where lang = 'de'"))
def hybrid_post_filter(t):
    return _shown(R.hybrid_search(_corpus(t), QUERY_TEXT, _vector(t), post_filter=F.col("lang") == "de"))


@query(_hybrid_sql(dense=False))
def hybrid_lexical_only(t):
    return _shown(R.service_search(_corpus(t), QUERY_TEXT, None))


@query(_hybrid_sql(lexical=False))
def hybrid_dense_only(t):
    return _shown(R.hybrid_search(_corpus(t), "", _vector(t)))


@query(f"""with s as (select a.vec_id as ask, a.label as source, b.vec_id as id, b.label as other, list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / sqrt(list_dot_product(cast(a.embedding as double[]), cast(a.embedding as double[])) * list_dot_product(cast(b.embedding as double[]), cast(b.embedding as double[]))) as score
    from (select *, row_number() over (partition by label order by vec_id) as n from embeddings) a, embeddings b where a.n <= 3),
  r as (select *, row_number() over (partition by ask order by score desc, cast(id as varchar)) as place from s where score >= {LINK_THRESHOLD})
  select source, count(distinct other) filter (where place <= 3 and other <> source) as links from (select distinct label as source from embeddings) left join r using (source) group by source""")
def cross_document_links(t):
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    chunks = t("embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").alias("source"), index.alias("chunk_index"), F.col("vec_id").alias("seq"), "embedding")
    return R.cross_document_links(chunks, LINK_THRESHOLD)


@query(f"""with {_CORPUS}, {_TOKS}, fused as (select id, sum(1.0 / (60 + rank)) as rrf from (select id, rank from ({_dense_sql(50)}) union all select id, rank from ({_bm25_sql(QUERY_TEXT, 50)})) group by id),
  top as (select *, row_number() over (order by rrf desc, id) as rank from (select * from fused order by rrf desc, id limit 10)),
  c as (select id, rank, trim(regexp_replace(text, '\\s+', ' ', 'g')) as body from top join corpus using (id) where rank <= 8),
  b as (select *, coalesce(sum(length(body)) over (order by rank rows between unbounded preceding and 1 preceding), 0) as before from c)
  select id, rank, cast(least(length(body), 12000 - before) as int) as kept_chars from b where before < 12000""")
def qa_context_budget(t):
    blocks = R.context_blocks(R.hybrid_search(_corpus(t), QUERY_TEXT, _vector(t)))
    return blocks.select("id", F.col("rank").cast("long").alias("rank"), F.char_length("kept").alias("kept_chars"))


# ------------------------------------------------------------------ state


@query("select sha256(text) as sha256, min(doc_id) as first_id, count(*) as copies from documents group by 1 having count(*) > 1")
def exact_duplicates(t):
    return S.exact_duplicates(t("documents"))


@query("with d as (select doc_id, sha256(text) as sha256 from documents) select doc_id, sha256 from d where sha256 not in (select sha256 from d join labels using (doc_id))")
def manifest_new_files(t):
    files = t("documents").select("doc_id", S.content_hash(F.col("text")).alias("sha256"))
    manifest = files.join(t("labels").select("doc_id"), "doc_id", "left_semi")
    return S.new_files(files, manifest).select("doc_id", "sha256")


@query("with f as (select user_id as path, min(struct_pack(created_at := ts, event_id := event_id)) as f from events group by user_id) select path, f.event_id as event_id, row_number() over (order by f.created_at, f.event_id) as position from f")
def queue_fifo_dedup(t):
    arrivals = t("events").select(F.col("user_id").alias("path"), F.col("ts").alias("created_at"), "event_id")
    return S.with_position(S.queue(arrivals)).select("path", "event_id", F.col("position").cast("long").alias("position"))


_EVENT_ITEMS = "select case when event_type = (select min(event_type) from events) then 'FAILED' else 'DONE' end as status, row_number() over (partition by user_id, props order by ts, event_id) > 1 as duplicate, value as seconds from events"


@query(f"with i as ({_EVENT_ITEMS}) select count(*) filter (where status = 'DONE' and not duplicate) as processed, count(*) filter (where duplicate) as skipped_duplicates, count(*) filter (where status = 'FAILED') as failed, count(*) as detection_events, round(coalesce(avg(seconds) filter (where status = 'DONE' and not duplicate), 0), 6) as average_seconds from i")
def runtime_stats(t):
    from pyspark.sql import Window

    events = t("events")
    least = events.agg(F.min("event_type").alias("least"))
    turn = F.row_number().over(Window.partitionBy("user_id", "props").orderBy("ts", "event_id"))
    items = events.crossJoin(F.broadcast(least)).select(F.when(F.col("event_type") == F.col("least"), "FAILED").otherwise("DONE").alias("status"), (turn > 1).alias("duplicate"), F.col("value").alias("seconds"))
    return S.runtime_stats(items).withColumn("average_seconds", r6("average_seconds"))


# ------------------------------------------------------------------ scalar text


def _hits_sql(lang: str) -> str:
    words = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS[lang]))
    return f"len(list_filter(w, lambda x: list_contains([{words}], x)))"


_LANGUAGE = f"""words as (select doc_id, lang, regexp_extract_all(lower(substr(coalesce(text, ''), 1, 10000)), '[a-zà-öø-ÿœæ]+') as w, regexp_matches(substr(coalesce(text, ''), 1, 10000), '[\\x{{3040}}-\\x{{30ff}}]') as kana from documents),
  hits as (select *, {_hits_sql('en')} as en, {_hits_sql('fr')} as fr, {_hits_sql('de')} as de, len(w) as n from words),
  best as (select *, greatest(en, fr, de) / greatest(n, 1) as share from hits),
  found as (select doc_id, lang, case when kana then 'ja' when share < 0.5 then 'en' when en >= fr and en >= de then 'en' when fr >= de then 'fr' else 'de' end as language, case when kana then 0.95 when share < 0.5 then 0.0 else share end as confidence from best)"""


@query(f"with {_LANGUAGE} select doc_id, language, round(confidence, 6) as confidence from found")
def language_detect(t):
    return spread(t("documents").select("doc_id", "text")).select("doc_id", C.language(F.col("text")).alias("l")).select("doc_id", "l.language", r6(F.col("l.confidence")).alias("confidence"))


@query(f"with {_LANGUAGE} select language, lang, count(*) as documents from found group by language, lang")
def language_confusion(t):
    found = spread(t("documents").select("lang", "text")).select("lang", C.language(F.col("text"))["language"].alias("language"))
    return found.groupBy("language", "lang").agg(F.count("*").alias("documents"))


@query(r"select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as text from pages")
def html_strip(t):
    return spread(t("pages").select("page_id", "html")).select("page_id", C.strip_html(F.col("html")).alias("text"))


@query(r"select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path from pages")
def url_parts(t):
    part = lambda what: F.try_parse_url("url", F.lit(what))
    return t("pages").select("page_id", part("PROTOCOL").alias("scheme"), F.lower(part("HOST")).alias("host"), part("PATH").alias("path"))


@query("""select page_id, case when starts_with(html, '%PDF-') then 'application/pdf' when starts_with(html, '<?xml') then 'application/xml'
  when starts_with(ltrim(substr(html, 1, 512)), '<!DOCTYPE html') or starts_with(ltrim(substr(html, 1, 512)), '<html') then 'text/html'
  when starts_with(ltrim(substr(html, 1, 512)), '{') or starts_with(ltrim(substr(html, 1, 512)), '[') then 'application/json' else 'text/plain' end as mime from pages""")
def mime_sniff(t):
    return t("pages").select("page_id", C.sniff_mime(F.col("html").cast("binary")).alias("mime"))


_EXTS = [*sorted(KIND_BY_EXTENSION), ".xyz", ""]
_EXT_SQL = ", ".join(f"('{e}', '{k}', {CONFIDENCE_BY_KIND.get(k, 0.4)}, '{PROCESSOR_BY_KIND.get(k, ('TextProcessor', 'general_text'))[0]}', '{PROCESSOR_BY_KIND.get(k, ('TextProcessor', 'general_text'))[1]}')" for e, k in [*sorted(KIND_BY_EXTENSION.items()), (".xyz", "unknown"), ("", "unknown")])


@query(f"""with k(ext, kind, confidence, processor, model) as (values {_EXT_SQL}), e as (select doc_id, [{', '.join(f"'{x}'" for x in _EXTS)}][doc_id % {len(_EXTS)} + 1] as ext from documents)
  select doc_id, kind, cast(confidence as double) as confidence, processor, model, kind in ('scanned_pdf', 'handwritten', 'image') as requires_ocr from e join k using (ext)""")
def classify_route(t):
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % len(_EXTS) + 1).cast("int"))
    docs = t("documents").select("doc_id", F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.upper(ext)).alias("filename"), F.lit("").alias("source_type"))
    return classify(docs).select("doc_id", "kind", "confidence", "processor", "model", "requires_ocr")


@query(r"select doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 200) as snippet from documents")
def snippets(t):
    return t("documents").select("doc_id", C.snippet(F.col("text")).alias("snippet"))


@query("select p_partkey, 'part::' || replace(lower(trim(p_name)), ' ', '_') as entity_id from part")
def entity_ids(t):
    return t("part").select("p_partkey", C.entity_id(F.lit("part"), F.col("p_name")).alias("entity_id"))


@query("select p_partkey, regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(p_type)), ' ', '-'), '^#+', ''), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') as tag from part")
def tag_normalize(t):
    return t("part").select("p_partkey", C.tag(F.col("p_type")).alias("tag"))


# ------------------------------------------------------------------ ordered text


@query()
def sentences_count(t):
    s = X.sentences(F.col("text"))
    return spread(t("documents").select("doc_id", "text")).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("sentences"), F.aggregate("s", F.lit(0), lambda n, x: n + F.char_length(x)).alias("chars"))


@query()
def chunks(t):
    return X.chunks(spread(t("documents")), "doc_id").withColumn("metadata", F.to_json("metadata"))


@query()
def chunk_overlap(t):
    from pyspark.sql import Window

    made = X.chunks(spread(t("documents")), "doc_id")
    previous = F.lag("chunk_index").over(Window.partitionBy("source").orderBy("chunk_index"))
    return made.select("chunk_id", F.char_length("text").alias("chars"), (F.col("end_char") - F.col("start_char")).alias("span"), previous.alias("previous"))


@query()
def clean_text(t):
    return t("conversations").select("conv_id", "turn", X.clean_text(F.col("text")).alias("text"))


def _markdown(t) -> DataFrame:
    """One Markdown text per region: nations as sections, suppliers as a list, a rule table and a fence."""
    suppliers = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("s"))
    nations = t("nation").join(suppliers, "n_nationkey", "left").withColumn("s", F.coalesce("s", F.expr("cast(array() as array<struct<s_suppkey:bigint,s_name:string>>)")))
    items = F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x["s_name"])), "\n")
    part = F.concat(F.lit("## "), F.col("n_name"), F.lit("\n\nNation text.\n\n"), F.when(F.size("s") > 0, F.concat(items, F.lit("\n\n"))).otherwise(F.lit("")), F.lit("| a | b |\n| --- | --- |\n| 1 | 2 |\n\n```\n# no heading\n```\n"))
    per = nations.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", part.alias("p")))).alias("ps"))
    body = F.array_join(F.transform("ps", lambda x: x["p"]), "\n")
    return t("region").join(per, "r_regionkey").select(F.col("r_name").alias("source"), F.concat(F.lit("# "), F.col("r_name"), F.lit("\n\nRegion text.\n\n"), body).alias("text"))


_NATIONS = "nations as (select r_name, n_nationkey, n_name, row_number() over (partition by r_regionkey order by n_nationkey) as n from nation join region on n_regionkey = r_regionkey), lists as (select s_nationkey as n_nationkey, string_agg('- ' || s_name, chr(10) order by s_suppkey) as items from supplier group by s_nationkey)"


@query(f"with {_NATIONS} select r_name as source, 's-1' as section_id, r_name as title, 1 as level, null as parent_id, 1 as blocks from region union all select r_name, 's-1-' || n, n_name, 2, 's-1', case when items is null then 3 else 4 end from nations left join lists using (n_nationkey)")
def sections(t):
    return X.section_rows(_markdown(t)).select("source", "section_id", "title", "level", "parent_id", F.size("blocks").alias("blocks"))


@query(f"with {_NATIONS} select r_name as source, 'b-s-1-1' as block_id, 'paragraph' as type, 'Region text.' as text from region union all select r_name, 'b-s-1-' || n || '-1', 'paragraph', 'Nation text.' from nations union all select r_name, 'b-s-1-' || n || '-2', 'list', items from nations join lists using (n_nationkey) union all select r_name, 'b-s-1-' || n || '-' || case when items is null then 2 else 3 end, 'table', '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' from nations left join lists using (n_nationkey) union all select r_name, 'b-s-1-' || n || '-' || case when items is null then 3 else 4 end, 'code', '```' || chr(10) || '# no heading' || chr(10) || '```' from nations left join lists using (n_nationkey)")
def blocks(t):
    return X.block_rows(_markdown(t)).select("source", "block_id", "type", "text")


# ------------------------------------------------------------------ entities and graphs


@query()
def entity_mentions(t):
    return X.mentions(spread(t("documents")), "doc_id")


@query()
def entities(t):
    return X.entity_table(X.mentions(spread(t("documents")), "doc_id")).select("source", "entity_id", "label", "entity_type", "n_mentions")


def _order_mentions(t) -> DataFrame:
    """Suppliers named in orders: a mention per line."""
    return t("lineitem").select(
        F.col("l_orderkey").alias("source"), F.lit(None).cast("string").alias("section_id"), F.concat(F.lit("supplier::"), F.col("l_suppkey").cast("string")).alias("entity_id"),
        F.col("l_linenumber").alias("ord"), F.lit(0).alias("start_char"), F.lit(0).alias("end_char"),
    )


_PAIRS = "m as (select l_orderkey, 'supplier::' || l_suppkey as e, count(*) as k from lineitem group by all), pairs as (select a.e as source_id, b.e as target_id, sum(a.k + b.k) as evidence from m a join m b on a.l_orderkey = b.l_orderkey and a.e < b.e group by all)"


@query(f"with {_PAIRS} select source_id || '::related_to::' || target_id as id, source_id, target_id, 1.0 as weight, cast(evidence as int) as evidence from pairs")
def relationships(t):
    return G.related_pairs(_order_mentions(t)).select("id", "source_id", "target_id", "weight", F.col("evidence").cast("int").alias("evidence"))


@query(f"with {_PAIRS} select 'node' as kind, count(distinct e) as n from m union all select 'edge', count(*) from pairs")
def document_graph(t):
    found = _order_mentions(t)
    named = found.select("source", "entity_id", F.col("entity_id").alias("label"), F.lit("supplier").alias("entity_type"))
    nodes, edges = G.document_graph(named, G.related_pairs(found))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def _region_graph(t) -> tuple[DataFrame, DataFrame]:
    nations = t("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("concepts"))
    suppliers = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("s_name")).alias("entities"))
    none = F.expr("cast(array() as array<struct<name:string,text:string>>)")
    notes = t("region").join(nations, "r_regionkey").join(suppliers, "r_regionkey").select(F.col("r_name").alias("title"), F.col("r_name").alias("source"), "concepts", "entities", none.alias("definitions"), F.array(F.lit("trade")).alias("topics"))
    return G.star(notes)


_SLUG = "replace(lower(trim({0})), ' ', '_')"
_KG = f"""base as (select r_name, n_name, s_name from region join nation on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey where r_regionkey in (select n_regionkey from nation join supplier on s_nationkey = n_nationkey)),
  edges as (select distinct 'note::' || {_SLUG.format('r_name')} as source_id, 'concept::' || {_SLUG.format('n_name')} as target_id, 'mentioned_in' as edge_type, 1.0 as weight from base
    union all select distinct 'note::' || {_SLUG.format('r_name')}, 'entity::' || {_SLUG.format('s_name')}, 'mentioned_in', 1.0 from base where s_name is not null
    union all select distinct 'note::' || {_SLUG.format('r_name')}, 'topic::trade', 'related_to', 1.0 from base
    union all select 'concept::' || {_SLUG.format('a.n_name')}, 'entity::' || {_SLUG.format('b.s_name')}, 'related_to', 0.5 from (select distinct r_name, n_name from base) a join (select distinct r_name, s_name from base where s_name is not null) b using (r_name)),
  nodes as (select distinct source_id as id from edges union select distinct target_id from edges)"""


@query(f"with {_KG} select source_id, target_id, edge_type, cast(weight as double) as weight from edges")
def kg_build(t):
    return _region_graph(t)[1].select("source_id", "target_id", "edge_type", "weight")


@query(f"with {_KG} select (select count(*) from nodes) as nodes, 2 * (select count(*) from edges) as edges")
def kg_merge(t):
    nodes, edges = G.merge([_region_graph(t), _region_graph(t)])
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


@query(f"with {_KG} select target_id as id, edge_type, cast(weight as double) as weight from edges where source_id = 'note::europe' union all select source_id, edge_type, weight from edges where target_id = 'note::europe' and source_id <> 'note::europe'")
def kg_neighbors(t):
    return G.neighbors(*_region_graph(t), "note::europe").select("id", "edge_type", "weight")


@query(f"""with recursive {_KG}, both_ways as (select source_id as a, target_id as b from edges union select target_id, source_id from edges),
  walk(id, d) as (select 'note::europe', 0 union select b, d + 1 from walk join both_ways on a = id where d < 2), near as (select id, min(d) as distance from walk group by id)
  select id, distance from near""")
def kg_subgraph_depth2(t):
    return G.subgraph(*_region_graph(t), "note::europe", 2)[0].select("id", "distance")


# ------------------------------------------------------------------ tables, notes, windows


@query("select r_name as source, n_name as name, cast(n_nationkey as varchar) as key from nation join region on n_regionkey = r_regionkey")
def csv_table_extract(t):
    line = F.concat_ws(";", F.col("n_nationkey").cast("string"), F.col("n_name"))
    per = t("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("ls"))
    text = F.concat(F.lit("key;name\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"), F.lit("\n"))
    made = t("region").join(per, "r_regionkey").select("r_name", T.csv_table(text).alias("t"))
    return made.select(F.col("r_name").alias("source"), F.explode("t.rows").alias("r")).select("source", F.col("r")[1].alias("name"), F.col("r")[0].alias("key"))


@query("select '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' |', chr(10) order by n_nationkey) as markdown from nation")
def markdown_table_render(t):
    return T.table_from_rows(t("nation"), ["n_nationkey", "n_name"], "n_nationkey")


@query("select conv_id, turn, role, lag(role) over (partition by conv_id order by turn, role) as previous_role, length(lag(text) over (partition by conv_id order by turn, role)) as previous_chars from conversations")
def chat_turn_lag(t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    return t("conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("previous_role"), F.char_length(F.lag("text").over(w)).cast("long").alias("previous_chars"))


def _notes(t) -> DataFrame:
    title = F.concat(F.lit("Note "), F.col("doc_id").cast("string"))
    return t("documents").select(F.col("source"), title.alias("title"), F.concat(title, F.lit(".md")).alias("filename"), F.lit("").alias("markdown"), "doc_id")


@query("select 'Note ' || doc_id as stem, '- [[Note ' || doc_id || '|Note ' || doc_id || ']]' as line, 'note ' || doc_id as sort_key from documents")
def note_index(t):
    return N.index_lines(_notes(t))


@query("select (select count(*) from documents) as notes, (select count(distinct source) from documents) as sources, (select string_agg(stem, ',' order by lower(stem), stem) from (select 'Note ' || doc_id as stem from documents order by lower(stem) desc, stem desc limit 10)) as recent")
def note_overview(t):
    return N.overview(_notes(t))


@query("select 'Note ' || doc_id || '.md' as filename, 'Note ' || doc_id as title, 'Benchmark' as backlink from (select distinct vec_id + (select count(*) // 2 from embeddings) as doc_id from embeddings) where doc_id not in (select doc_id from labels)")
def placeholders(t):
    notes = t("labels").select(F.concat(F.lit("Note "), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"))
    half = t("embeddings").agg(F.floor(F.count("*") / 2).alias("half"))
    wanted = t("embeddings").crossJoin(F.broadcast(half)).select(F.concat(F.lit("Note "), (F.col("vec_id") + F.col("half")).cast("string")).alias("title"), F.lit("Benchmark").alias("backlink"))
    return N.placeholders(notes, wanted).select("filename", "title", "backlink")


# ------------------------------------------------------------------ streaming


def _event_stream(t) -> DataFrame:
    # A glob: the source may be one file or a folder.
    stream = t.spark.readStream.schema(t("events").schema).parquet(f"{t.dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("select user_id, min(event_id) as event_id from events group by user_id")
def stream_dedup_replay(t):
    """Queue semantics on a stream: the first event of each user, against what earlier batches kept."""
    out, place = fresh_path(t.spark, "stream-dedup"), fresh_path(t.spark, "stream-dedup-checkpoint")

    def batch(df: DataFrame, number: int) -> None:
        df.groupBy("user_id").agg(F.min("event_id").alias("event_id")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    _event_stream(t).writeStream.foreachBatch(batch).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{out}/*").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as events, round(avg(value), 6) as mean_value from events group by all")
def stream_stats(t):
    out, place = fresh_path(t.spark, "stream-stats"), fresh_path(t.spark, "stream-stats-checkpoint")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stats = W.windowed_stats(_event_stream(t), "ts", "1 hour", "365 days", "event_type")
    stats.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    newest = t.spark.read.option("basePath", out).parquet(out)
    last = newest.agg(F.max("batch").alias("batch"))
    return newest.join(F.broadcast(last), "batch").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", r6("mean_value").alias("mean_value"))
