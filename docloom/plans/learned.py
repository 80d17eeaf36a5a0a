"""Queries of what is learned from a corpus and of what comes from callers' services."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.observability import Counters
from docloom.operators import boundaries as B
from docloom.operators import models, processors
from docloom.operators import tables as T
from docloom.operators import text as X
from docloom.plans.catalog import query
from docloom.runtime import spread
from docloom.sources import remote

_WORDS = r"""w as (select list_transform(list_transform(string_split_regex(coalesce(text, ''), '\s+'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$', '', 'g')),
    lambda x: case when regexp_full_match(x, '\p{L}([\p{L}.]*\p{L})?\.?') then x else '' end) as w from documents),
  p as (select unnest(w) as word, unnest(list_concat([null], w[1:len(w) - 1])) as prior from w),
  k as (select lower(regexp_replace(word, '\.$', '')) as type, ends_with(word, '.') as dot, case when ends_with(prior, '.') then lower(regexp_replace(prior, '\.$', '')) end as prior, prior is not null as follows from p where word <> ''),
  c as (select type, count(*) filter (dot) as dotted, count(*) filter (not dot) as plain from k group by type),
  n as (select sum(dotted) / sum(dotted + plain) as p from c),
  s as (select type, dotted, plain, length(replace(type, '.', '')) as len, 2 * (dotted * (ln(0.99) - ln(p)) + plain * (ln(0.01) - ln(greatest(1 - p, 1e-12)))) as ll from c, n where dotted > 0),
  a as (select type, dotted, plain, ll * exp(-len) * (length(type) - len + 1) * power(cast(len as double), -plain) as score from s)"""


@query(f"with {_WORDS} select type, dotted, plain, round(score, 4) + 0.0 as score from a")
def abbreviation_scores(t) -> DataFrame:
    return B.abbreviation_scores(spread(t("documents"))).withColumn("score", F.round("score", 4) + F.lit(0.0))  # no negative zero


@query(f"""with {_WORDS},
  e as (select k.type, count(*) filter (k.prior is not null and a.type is null) as after_end, count(*) filter (k.prior is null or a.type is not null) as elsewhere
    from k left join (select type from a where score >= 0.3) a on a.type = k.prior where k.follows group by k.type),
  m as (select sum(after_end) as n1, sum(elsewhere) as n2 from e),
  q as (select type, after_end as k1, elsewhere as k2, n1, n2, (after_end + elsewhere) / (n1 + n2) as p, after_end / n1 as p1, elsewhere / n2 as p2 from e, m where after_end > 0)
  select type, k1 as after_end, k2 as elsewhere, round(2 * (k1 * ln(p1) + case when n1 > k1 then (n1 - k1) * ln(1 - p1) else 0 end + case when k2 > 0 then k2 * ln(p2) else 0 end + (n2 - k2) * ln(1 - p2)
    - k1 * ln(p) - (n1 - k1) * ln(1 - p) - k2 * ln(p) - (n2 - k2) * ln(1 - p)), 4) as score from q where p1 > p2""")
def sentence_starters(t) -> DataFrame:
    docs = spread(t("documents").select("text"))
    short = B.abbreviation_scores(docs).where(F.col("score") >= B.ABBREVIATION_SCORE)
    return B.starter_scores(docs, short).withColumn("score", F.round("score", 4))


@query("""with c as (select c_custkey as k from customer), s as (
  select k, 0 as place, 'The boats of ' || k || ' carry abt. 7 tons.' as sentence from c
  union all select k, 1, 'Then Hr. ' || k || ' sold tons of salt to boats.' from c
  union all select k, 2, 'The salt went by boats of abt. nine tons.' from c) select k as c_custkey, place, sentence from s""")
def trained_sentences_built(t) -> DataFrame:
    """Sentences around two abbreviations that no list holds; they are learned from the same texts."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("The boats of "), key, F.lit(" carry abt. 7 tons. Then Hr. "), key, F.lit(" sold tons of salt to boats.\nThe salt went by boats of abt. nine tons."))
    docs = spread(t("customer").select("c_custkey")).select("c_custkey", text.alias("text"))
    return X.split_sentences(docs, splitter=B.trained(docs)).select("c_custkey", F.posexplode("sentences").alias("place", "sentence"))


# ------------------------------------------------------------------ services of callers

_KINDS = ("markdown", "web", "text", "code", "config", "pdf", "scanned_pdf", "handwritten", "docx", "pptx", "research", "csv", "database", "notebook", "image", "audio", "video", "archive", "email", "diagram")
_SPECS = """('markdown', 'MarkdownProcessor', 'general_text', 'markdown', 0.95), ('web', 'WebProcessor', 'general_text', 'web', 0.90), ('text', 'TextProcessor', 'general_text', null, 0.95),
  ('code', 'CodeProcessor', 'programming', 'code', 0.92), ('config', 'ConfigProcessor', 'general_text', 'config', 0.93), ('pdf', 'PDFProcessor', 'general_text', 'pdf', 0.90),
  ('scanned_pdf', 'OCRProcessor', 'scanned_ocr', 'scanned_pdf', 0.50), ('handwritten', 'HandwritingProcessor', 'handwriting_ocr', 'handwritten', 0.40), ('docx', 'DocxProcessor', 'general_text', 'docx', 0.90),
  ('pptx', 'PptxProcessor', 'general_text', 'pptx', 0.88), ('research', 'ResearchProcessor', 'general_text', 'research', 0.88), ('csv', 'TableProcessor', 'general_text', null, 0.88),
  ('database', 'DatabaseProcessor', 'general_text', 'database', 0.85), ('notebook', 'NotebookProcessor', 'general_text', 'notebook', 0.90), ('image', 'VisionProcessor', 'vision', 'image', 0.85),
  ('audio', 'AudioProcessor', 'audio', 'audio', 0.85), ('video', 'VideoProcessor', 'vision', 'video', 0.70), ('archive', 'ArchiveProcessor', 'general_text', 'archive', 0.80),
  ('email', 'EmailProcessor', 'general_text', 'email', 0.88), ('diagram', 'DiagramProcessor', 'general_text', 'diagram', 0.85)"""
_LIST = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"


@query(f"""with m(kind, processor, model, stamped, confidence) as (values {_SPECS}),
  d as (select o_orderkey as k, {_LIST}[1 + o_orderkey % {len(_KINDS)}] as kind, o_orderpriority as body from orders),
  r as (select cast(k as varchar) as source, kind, case when k % 3 = 0 then 'T' || k when k % 3 = 1 then 'f' || k || '.bin' else cast(k as varchar) end as title,
    case kind when 'audio' then upper(body) when 'image' then 'seen ' || body else body end as content from d)
  select source, r.kind, processor, model, title, content, '# ' || title || chr(10) || chr(10) || content as markdown, coalesce(stamped, 'own') as source_type, cast(confidence as double) as confidence,
    r.kind in ('audio', 'image') as model_used from r join m on m.kind = r.kind""")
def routed_processing(t) -> DataFrame:
    """Orders as documents of twenty kinds: two processors have services, the others pass their text on."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % len(_KINDS) + 1).cast("int"))
    docs = t("orders").select(
        k.cast("string").alias("source"), kind.alias("kind"), F.lit("own").alias("source_type"), F.when(k % 3 == 1, F.concat(F.lit("f"), k.cast("string"), F.lit(".bin"))).alias("filename"),
        F.when(k % 3 == 0, F.concat(F.lit("T"), k.cast("string"))).alias("title"), F.col("o_orderpriority").alias("text"), F.col("o_orderpriority").cast("binary").alias("content"),
    )
    see = lambda rows: rows.select("source", F.concat(F.lit("seen "), "text").alias("text"))
    return processors.process(docs, {"AudioProcessor": processors.hearing(lambda data: [data.decode().upper()]), "VisionProcessor": see})


@query("""select s_suppkey, 'flowchart LR' || chr(10) || '    n_1["Port ' || chr(39) || s_nationkey || chr(39) || '"]' || chr(10) || '    Dock' || chr(10) || '    n_1 -->|"' || s_suppkey || ' boats"| Dock'
  || chr(10) || '    Dock --> n_1' as mermaid from supplier""")
def drawio_flowchart_built(t) -> DataFrame:
    """Diagrams with two nodes, an edge with and an edge without a label."""
    say = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in x))
    xml = say(
        '<mxfile><diagram><mxGraphModel><root><mxCell id="0"/><mxCell id="1" value="&lt;b&gt;Port&lt;/b&gt; &quot;', F.col("s_nationkey"), '&quot;" vertex="1"/><mxCell id="Dock" value=" Dock "/>',
        '<mxCell id="e" edge="1" source="1" target="Dock" value="', F.col("s_suppkey"), ' boats"/><mxCell id="f" style="edgeStyle=none" source="Dock" target="1"/></root></mxGraphModel></diagram></mxfile>',
    )
    return t("supplier").select("s_suppkey", T.flowchart(T.drawio_drawing(xml)).alias("mermaid"))


def _server(prompt: str) -> object:
    """A model server that refuses, fails and answers by the number in the prompt."""
    number = int(prompt.split()[-1])
    match number % 7:
        case 0:
            raise models.ServiceError(404)
        case 1:
            raise models.ServiceError(429)
        case 2:
            raise models.ServiceError(503)
        case 3:
            raise TimeoutError
        case 4:
            raise ConnectionError
        case 5:
            return ""
    return f' {{"key": {number}, "region": "r{number % 3}"}} '


@query("""select c_custkey, case when c_custkey % 7 = 6 then cast(c_custkey as varchar) end as key, case when c_custkey % 7 = 6 then 'r' || c_custkey % 3 end as region,
  case c_custkey % 7 when 0 then 'NoSuchModel: status 404' when 1 then 'BadAnswer: status 429' when 2 then 'BadAnswer: status 503' when 3 then 'TimedOut: no answer in time' when 4 then 'Unreachable: no connection'
    when 5 then 'BadAnswer: the answer is empty' end as answer_error from customer""")
def model_answers(t) -> DataFrame:
    """One call a customer to a server that fails in every way; errors are rows."""
    prompt = F.concat(F.lit("customer "), F.col("c_custkey").cast("string"))
    asked = models.generate_json(t("customer").select("c_custkey"), prompt, _server, "key string, region string", retries=1, backoff=0.0)
    return asked.select("c_custkey", "answer.key", "answer.region", "answer_error")


def _repositories(address: str) -> str:
    """A repository service: the names end with a number, which decides what is there."""
    name = address.removesuffix("/readme").rsplit("/", 1)[1]
    if int(name[1:]) % 5 == 2:
        raise models.ServiceError(404, "not found")
    if not address.endswith("/readme"):
        return json.dumps({"full_name": f"ports/{name}"})
    text = "" if int(name[1:]) % 5 == 4 else f"#  Port {name}\n\n\n\nIt   is open."
    return json.dumps({"content": base64.b64encode(text.encode()).decode(), "name": "ReadMe.md"})


def _transcripts(video: str) -> str:
    return json.dumps({"snippets": [{"text": f"this is {video}"}, {"text": "and ends"}]})


@query("""with s as (select s_suppkey as k, s_suppkey % 5 as m, 'r' || s_suppkey as name from supplier)
  select case m when 1 then 'https://youtu.be/v' || k when 3 then 'https://example.org/' || name else 'https://github.com/ports/' || name end as source,
    case when m = 1 then 'youtube_transcript' when m = 0 then 'github_readme' when m = 3 then null else 'repository' end as source_type,
    case m when 1 then 'v' || k || '.transcript.md' when 0 then 'ReadMe.md' end as filename, case m when 1 then 'this is v' || k || chr(10) || 'and ends' when 0 then '# Port ' || name || chr(10) || chr(10) || 'It is open.' end as text,
    case m when 1 then 'YouTube Transcript - v' || k when 0 then 'ports/' || name end as title, case m when 2 then 'not found' when 3 then 'no reader for this URL' when 4 then 'the README is empty' end as reason from s""")
def remote_documents(t) -> DataFrame:
    """READMEs and transcripts of suppliers' URLs from a caller's services; what can't be read has a reason."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("r"), k.cast("string"))
    url = F.when(k % 5 == 1, F.concat(F.lit("https://youtu.be/v"), k.cast("string"))).when(k % 5 == 3, F.concat(F.lit("https://example.org/"), name)).otherwise(F.concat(F.lit("https://github.com/ports/"), name))
    return remote.read_remote(t("supplier").select(url.alias("url")), _repositories, _transcripts).select("source", "source_type", "filename", "text", "title", "reason")


@query("""select 'priced' as stage, count(*) as rows_in, count(*) filter (o_totalprice >= 150000) as rows_out, count(*) filter (o_totalprice < 150000) as rejected from orders
  union all select 'open', count(*), count(*) filter (o_orderstatus = 'O'), count(*) filter (o_orderstatus <> 'O') from orders where o_totalprice >= 150000""")
def stage_counters(t) -> DataFrame:
    """Two stages over the orders, counted while they are written."""
    counters = Counters(t.spark, "orders")
    priced = counters.staged(t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "priced", F.col("o_totalprice") >= 150000)
    counters.staged(priced.where("o_totalprice >= 150000"), "open", F.col("o_orderstatus") == "O")
    return counters.table().drop("run", "seconds")
