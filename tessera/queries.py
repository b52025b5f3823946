"""Registered queries of the library, each with the SQL that gives the same rows.

Arrays are joined to text and counts are BIGINT, so that both engines give the same types.  Scores are
rounded to nine digits before they are ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import rules as r
from .functions import text as t
from .operators import calibration, chunking, communities, enrichment, evaluation, extraction, graph, scoring
from .plans import context, experiments, iterative, ranking
from .plans.config import Settings
from .plans.index import Index, build_index, enrich_index, test_documents
from .sources import datasets, files
from .storage import materialize, scratch, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


def listed(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), "|").alias(c)


# --- SQL pieces -----------------------------------------------------------------------------------------

_STOP = "[" + ",".join(f"'{w}'" for w in t.STOPWORDS) + "]"


def tok(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '[\\p{{L}}\\p{{N}}_''-]+'), lambda x: lower(x))"


def ctok(x: str) -> str:
    return f"list_filter({tok(x)}, lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x))"


def cf(x: str) -> str:
    return f"replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), 'ς', 'σ')"


def wds(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '\\S+')"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sents(x: str) -> str:
    marked = f"regexp_replace(coalesce({x}, ''), '([.!?])\\s+', '\\1' || chr(10), 'g')"
    return f"list_filter(list_transform(string_split_regex({marked}, '\\n+'), lambda s: {trimmed('s')}), lambda s: s <> '')"


def sid(prefix: str, *values: str) -> str:
    return f"'{prefix}_' || substr(sha1(concat_ws(chr(31), {', '.join(values)})), 1, 16)"


def ekey(x: str) -> str:
    return f"regexp_replace({cf(x)}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


def found_names(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '{t.NAME}', 1), lambda n: {trimmed('n')}), lambda n: length(n) > 1)"


def est(x: str) -> str:
    return f"greatest(1, ceil(len({tok(x)}) * 1.25))::BIGINT"


def counted_cosine(a: str, b: str) -> str:
    """Cosine of the counts of two token lists."""
    n = lambda of: f"sqrt(list_sum(list_transform(list_distinct({of}), lambda x: pow(len(list_filter({of}, lambda y: y = x)), 2)))::DOUBLE)"
    dot = f"coalesce(list_sum(list_transform(list_intersect(list_distinct({a}), list_distinct({b})), lambda x: len(list_filter({a}, lambda y: y = x)) * len(list_filter({b}, lambda y: y = x)))), 0)::DOUBLE"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {dot} / ({n(a)} * {n(b)}) ELSE 0.0 END"


def when_chain(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){pattern(p)}') THEN '{name}'" for name, p in r.RELATIONS) + " ELSE 'co_occurs' END"


def pattern(p: str) -> str:
    """A relation pattern with Unicode word boundaries spelled out for an engine whose \\b is ASCII."""
    return p.replace(r"\b(?:", r"(?:^|[^\p{L}\p{N}_])(?:", 1)[: -len(r"\b")] + r"(?:$|[^\p{L}\p{N}_])"


_UNITS = f"""
docs AS (
  SELECT doc_id AS id, array_to_string(({wds('text')})[1:12], ' ') AS title, text, source, lang AS category FROM documents),
split AS (SELECT id AS document_id, {wds('text')} AS w FROM docs),
units0 AS (
  SELECT document_id, unnest(range(0, CASE WHEN len(w) <= 600 THEN 1 ELSE 1 + ceil((len(w) - 600) / 500.0)::BIGINT END)) AS position, w
  FROM split WHERE len(w) > 0),
units1 AS (SELECT document_id, position, array_to_string(w[position * 500 + 1 : position * 500 + 600], ' ') AS text FROM units0),
units AS (
  SELECT {sid('tu', 'document_id::VARCHAR', 'position::VARCHAR', 'text')} AS id, document_id, position, text, {est('text')} AS token_count FROM units1)"""

_ROWS = f"""{_UNITS},
sent AS (
  SELECT id AS unit_id, document_id, position, s.k AS k, s.evidence AS evidence FROM (
    SELECT id, document_id, position, unnest(list_transform(list_zip(range(len(ss)), ss), lambda z: {{'k': z[1], 'evidence': z[2]}})) AS s
    FROM (SELECT *, {sents('text')} AS ss FROM units))),
named AS (SELECT *, {found_names('evidence')} AS e FROM sent),
pairs AS (
  SELECT *, e[1] AS source, list_filter(e, lambda x: x <> e[1])[1] AS target, {when_chain('evidence')} AS raw FROM named
  WHERE len(list_distinct(e)) >= 2),
rel_rows AS (
  SELECT unit_id, document_id, position, k, evidence, source, target,
         CASE WHEN raw = 'co_occurs' THEN 'associated_with' ELSE raw END AS relation, raw <> 'co_occurs' AS ontology_ok,
         CASE WHEN raw = 'co_occurs' THEN 'implicit' ELSE 'explicit' END AS evidence_type,
         CASE WHEN raw = 'co_occurs' THEN 0.45 ELSE 0.75 END::DOUBLE AS llm_conf,
         row_number() OVER (ORDER BY document_id, position, k) AS ord
  FROM pairs)"""

_EDGES = f"""{_ROWS},
merged AS (
  SELECT {cf('source')} AS s, {cf('target')} AS t, relation, count(*)::DOUBLE AS weight,
         arg_min(source, ord) AS source, arg_min(target, ord) AS target, arg_min(evidence, ord) AS evidence_text,
         arg_min(evidence_type, ord) AS evidence_type, arg_min(llm_conf, ord) AS llm_conf, arg_min(ontology_ok, ord) AS ontology_ok, min(ord) AS ord,
         list(unit_id ORDER BY ord) AS unit_list, list(document_id ORDER BY ord) AS doc_list
  FROM rel_rows GROUP BY 1, 2, 3),
edges0 AS (
  SELECT *, {sid('edge', 's', 't', 'relation')} AS id,
         list_filter(unit_list, lambda x, i: list_position(unit_list, x) = i) AS text_unit_ids,
         list_filter(doc_list, lambda x, i: list_position(doc_list, x) = i) AS source_docs,
         source || ' ' || replace(relation, '_', ' ') || ' ' || target || '. ' || evidence_text AS edge_text
  FROM merged),
deg AS (SELECT title, count(*) AS degree FROM (SELECT unnest([source, target]) AS title FROM edges0) GROUP BY 1),
edges AS (
  SELECT e.*, a.degree + b.degree AS combined_degree FROM edges0 e JOIN deg a ON a.title = e.source JOIN deg b ON b.title = e.target)"""

_CLIP = "round(greatest(0.0, least(1.0, {})), 6)"
_CAL = f"""{_EDGES},
cal0 AS (
  SELECT *, count(*) OVER (PARTITION BY relation) AS rel_n, count(*) OVER () AS n, max(combined_degree) OVER () AS max_cd,
         count(*) OVER (PARTITION BY s, t) - count(*) OVER (PARTITION BY s, t, relation) AS conflicts,
         list_distinct({ctok("source || ' ' || target || ' ' || relation")}) AS alias, {ctok('evidence_text')} AS ev
  FROM edges),
cal1 AS (
  SELECT *, {_CLIP.format("0.4 * llm_conf + 0.3 * (len(list_intersect(alias, list_distinct(ev))) / greatest(1, len(alias))::DOUBLE) + 0.2 * CASE evidence_type WHEN 'explicit' THEN 1.0 WHEN 'table' THEN 0.7 ELSE 0.4 END::DOUBLE + 0.1 * least(1.0, 0.5 + 0.2 * greatest(0, len(source_docs) - 1))::DOUBLE")} AS evidence_score,
         CASE WHEN ontology_ok THEN 1.0 ELSE 0.0 END::DOUBLE AS ontology_score,
         {_CLIP.format('0.55 * (CASE WHEN max_cd > 0 THEN ln(1 + combined_degree) / ln(1 + max_cd) ELSE 0 END) + 0.45 * (ln(1 + rel_n) / ln(1 + greatest(1, n)))')} AS structural_score,
         {_CLIP.format('1.0 - least(0.75, 0.25 * conflicts)::DOUBLE')} AS consistency_score,
         CASE WHEN conflicts > 0 THEN 'review' ELSE 'ok' END AS conflict_status
  FROM cal0),
cal AS (SELECT *, {_CLIP.format('0.35 * evidence_score + 0.25 * ontology_score + 0.2 * structural_score + 0.2 * consistency_score')} AS reliability FROM cal1)"""

_QUERIES = "q AS (SELECT item_id AS qid, text FROM benchmark)"


def bm25_sql(posts: str, stats: str, terms: str, query: list[str], corpus: list[str], item: list[str], name: str = "bm") -> str:
    """CTEs ``name``0, .. and ``name`` (*query, *corpus, *item, score)."""
    c, q, i = corpus, query, item
    both = list(dict.fromkeys([*q, *c]))
    on = lambda a, b, keys: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys) or "TRUE"
    sel = lambda a, keys: "".join(f"{a}.{k}, " for k in keys)
    shared = [k for k in q if k in c]
    impact = f"ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {scoring.K1 + 1} / (tf + {scoring.K1} * ({1 - scoring.B} + {scoring.B} * dl / greatest(1.0, avgdl)))"
    group = ", ".join(dict.fromkeys([*[f"qt.{k}" for k in q], *[f"u.{k}" for k in c if k not in q], *[f"u.{k}" for k in i]]))
    return f"""
{name}_u AS (SELECT p.* FROM {posts} p WHERE p.term IN (SELECT term FROM {terms})),
{name}_df AS (SELECT {sel('x', c)}term, count(*) AS df FROM {name}_u x GROUP BY ALL),
{name}_w AS (SELECT u.*, {impact} AS impact FROM {name}_u u JOIN {name}_df d ON d.term = u.term AND {on('u', 'd', c)} JOIN {stats} st ON {on('u', 'st', c)}),
{name}_s AS (SELECT {group}, sum(qtf * impact) AS raw FROM {name}_w u JOIN {terms} qt ON qt.term = u.term AND {on('u', 'qt', shared)} GROUP BY ALL),
{name} AS (SELECT * EXCLUDE (raw), round(raw / max(raw) OVER (PARTITION BY {', '.join(both)}), 9) AS score FROM {name}_s)"""


def posts_sql(texts: str, by: list[str], name: str) -> str:
    """CTEs for postings ``name``_p and statistics ``name``_st of (*by, text)."""
    keys, corpus = ", ".join(by), ", ".join(by[:-1])
    head = f"{corpus}, " if corpus else ""
    return f"""
{name}_t AS (SELECT {keys}, {ctok('text')} AS tk FROM {texts}),
{name}_p AS (SELECT {keys}, dl, term, count(*) AS tf FROM (SELECT {keys}, len(tk) AS dl, unnest(tk) AS term FROM {name}_t) GROUP BY ALL),
{name}_st AS (SELECT {head}count(*) AS n, avg(len(tk)::DOUBLE) AS avgdl FROM {name}_t {'GROUP BY ' + corpus if corpus else ''})"""


def terms_sql(queries: str, by: list[str], name: str) -> str:
    keys = ", ".join(by)
    return f"{name} AS (SELECT {keys}, term, count(*) AS qtf FROM (SELECT {keys}, unnest({ctok('text')}) AS term FROM {queries}) GROUP BY ALL)"


# --- inputs -----------------------------------------------------------------------------------------------


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the benchmark passages."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def units_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(test_documents(spark, sf_dir))


def small_index(spark: SparkSession, sf_dir: str, with_communities: bool = False) -> Index:
    return build_index(test_documents(spark, sf_dir), with_communities=with_communities)


def graph_index(spark: SparkSession, sf_dir: str) -> Index:
    """For queries that read entities and edges, but no units."""
    return build_index(test_documents(spark, sf_dir), with_communities=False, keep_units=False)


# --- text -------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({tok('text')})::BIGINT AS n_tokens, len({ctok('text')})::BIGINT AS n_content, {est('text')} AS estimated, md5(array_to_string({ctok('text')}, ' ')) AS digest FROM documents")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    c = t.content_tokens(x)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(t.tokens(x)).cast("long").alias("n_tokens"), F.size(c).cast("long").alias("n_content"), t.estimate_tokens(x).alias("estimated"), F.md5(F.array_join(c, " ")).alias("digest")
    )


@query(f"SELECT doc_id, len({sents('text')})::BIGINT AS n_sentences, md5(array_to_string({sents('text')}, chr(10))) AS digest FROM documents")
def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(F.array_join(s, "\n")).alias("digest"))


@query(f"SELECT doc_id, {sid('doc', 'doc_id::VARCHAR', 'source', 'substr(text, 1, 256)')} AS id, md5({cf('text')}) AS folded, md5({ekey('text')}) AS entity_key FROM documents")
def text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", t.stable_id("doc", F.col("doc_id"), F.col("source"), F.substring("text", 1, 256)).alias("id"), F.md5(t.casefold(F.col("text"))).alias("folded"), F.md5(t.entity_key(F.col("text"))).alias("entity_key")
    )


@query(f"SELECT doc_id, array_to_string(({wds('text')})[1:144], ' ') AS kept FROM documents")
def text_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.truncate_to_tokens(F.col("text"), 180).alias("kept"))


@query(f"WITH a AS (SELECT doc_id, {found_names('text')} AS e FROM documents) SELECT doc_id, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), '|') AS names FROM a")
def text_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(t.names(F.col("text")), "|").alias("names"))


@query(
    f"WITH a AS (SELECT conv_id, turn, {ctok('text')} AS ta, {ctok('lead(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS tb FROM conversations) "
    f"SELECT conv_id, turn, round({counted_cosine('ta', 'tb')}, 9) AS similarity FROM a"
)
def text_lexical_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each turn and the one after it are; the last of a conversation has nothing after it."""
    follows = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.content_tokens(F.col("text")).alias("x"), follows.alias("next"))
    pairs = pairs.withColumn("y", t.content_tokens(F.col("next")))
    return pairs.select("conv_id", "turn", F.round(t.lexical_of(F.col("x"), F.col("y")), 9).alias("similarity"))


def _intent_sql(x: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({cf(x)}, '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in r.INTENTS) + " ELSE 'exploratory' END"


@query(f"SELECT conv_id, turn, {_intent_sql('text')} AS intent FROM conversations")
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r.intent(F.col("text")).alias("intent"))


_HINT_CASES = ", ".join(f"CASE WHEN list_has_any(k, [{','.join(repr(w) for w in ws)}]) THEN '{p}' END" for ws, p in r.HINTS)


@query(
    f"WITH a AS (SELECT conv_id, turn, {ctok('text')} AS k FROM conversations), b AS (SELECT conv_id, turn, list_filter([{_HINT_CASES}, array_to_string((list_filter(k, lambda x: length(x) > 2 AND NOT list_contains([{','.join(repr(w) for w in r.GENERIC)}], x)))[1:5], ' ')], lambda h: h IS NOT NULL AND h <> '') AS h FROM a) "
    "SELECT conv_id, turn, array_to_string((list_filter(h, lambda x, i: list_position(h, x) = i))[1:4], '|') AS hints FROM b"
)
def query_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(r.relation_hints(F.col("text")), "|").alias("hints"))


_SPLIT = r"\s*(?:,?\s+(?:and|while|whereas|as well as|according to|as reported by)\s+|[;])\s*"


@query(
    f"""WITH a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS w FROM conversations),
b AS (SELECT *, list_transform(string_split_regex(w, '(?i){_SPLIT}'), lambda p: regexp_replace(p, '^[ ,.?]+|[ ,.?]+$', '', 'g')) AS p, {cf("regexp_replace(w, '^[ ,.?]+|[ ,.?]+$', '', 'g')")} AS wk FROM a),
c AS (SELECT *, list_filter(p, lambda x: len({ctok('x').replace('lambda x:', 'lambda y:').replace('lower(x)', 'lower(y)').replace('length(x)', 'length(y)').replace(', x))', ', y))')}) >= 4 AND {cf('x')} <> wk) AS g FROM b)
SELECT conv_id, turn, CASE WHEN w = '' THEN '' ELSE array_to_string(list_concat([w], g[1:3]), '|') END AS clauses FROM c"""
)
def query_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(r.decompose(F.col("text")), "|").alias("clauses"))


# --- sources ----------------------------------------------------------------------------------------------


# Scripts and styles are raw text, which holds no tags or entities; of the entities those that the pages use.
_HTML_SQL = r"""WITH p AS (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|</?[a-z!][^>]*>|[^<]+|<') AS parts FROM pages),
q AS (SELECT page_id, url, list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '(?i)^<(script|style)\b') THEN regexp_replace(x, '(?is)^<[^>]*>(.*)</[^>]*>$', '\1')
WHEN x LIKE '<_%' THEN '' ELSE regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') END) AS parts FROM p)
SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ') AS text FROM q"""


@query(_HTML_SQL)
def source_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", files.html_to_text(F.col("html")).alias("text"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AS has_props FROM events")
def source_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("props").isNotNull().alias("has_props"))


@query(f"SELECT doc_id::VARCHAR AS id, coalesce(nullif({trimmed('text')}, ''), '') AS text, 'documents.parquet' AS source FROM documents WHERE length({trimmed('text')}) >= 30")
def dataset_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.normalize_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), "documents.parquet").select("id", "text", "source")


_DEDUPE_SQL = "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text"


@query("SELECT item_id::VARCHAR AS qid, text, 'yes' AS answer, 'unknown' AS question_type, 'qa.parquet' AS source FROM benchmark WHERE text <> ''")
def dataset_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ID"), F.col("text").alias("Question"), F.lit("yes").alias("gold_answer"))
    return datasets.normalize_qa(raw, "qa.parquet").select("qid", "text", "answer", "question_type", "source")


@query(_DEDUPE_SQL)
def dataset_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("digest", F.md5("text"))
    return datasets.dedupe(docs, "digest", F.col("doc_id")).select("doc_id", "digest")


@query(
    """WITH e AS (SELECT doc_id::VARCHAR AS url FROM labels WHERE toxic = 1), d AS (SELECT doc_id, doc_id::VARCHAR IN (SELECT url FROM e) AS p FROM documents)
SELECT doc_id FROM d WHERE p UNION ALL SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM d WHERE NOT p) WHERE n <= greatest(0, 100 - (SELECT count(*) FROM d WHERE p))"""
)
def dataset_evidence_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that are evidence and others up to 100 documents in all; the limit is what the operator is for."""
    proof = table(spark, sf_dir, "labels").where("toxic = 1").select(F.array(F.struct(F.col("doc_id").cast("string").alias("url"), F.lit("").alias("title"))).alias("evidence"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("none").alias("title"))
    return datasets.evidence_first(docs, proof, 100).select(F.col("id").alias("doc_id"))


_PARAGRAPHS = f"""p0 AS (SELECT conv_id::VARCHAR AS qid, turn, coalesce(nullif(role, ''), 'paragraph-' || turn::VARCHAR) AS title, {trimmed("coalesce(text, '')")} AS text, role = 'user' AS proof FROM conversations),
p AS (SELECT *, 'musique:' || substr(sha1(concat_ws(chr(10), title, turn::VARCHAR, text)), 1, 16) AS id FROM p0 WHERE length(text) >= 30)"""


def paragraph_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each conversation; its turns are paragraphs, those of the user support the answer."""
    turn = F.struct(F.col("turn").alias("idx"), F.col("role").alias("title"), F.col("text").alias("paragraph_text"), (F.col("role") == "user").alias("is_supporting"))
    each = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("paragraphs"))
    return each.select("id", F.concat(F.lit("What is said in "), "id").alias("question"), F.lit("much").alias("answer"), "paragraphs")


@query(f"WITH {_PARAGRAPHS} SELECT DISTINCT id, title, md5(text) AS digest, 'musique_ans_dev' AS source FROM p")
def dataset_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.normalize_paragraph_qa(paragraph_questions(spark, sf_dir))[0].select("id", "title", F.md5("text").alias("digest"), "source")


@query(
    f"WITH {_PARAGRAPHS}, e AS (SELECT qid, string_agg(id, '|' ORDER BY turn) AS ids, count(*) AS n FROM p WHERE proof GROUP BY 1) "
    "SELECT a.qid, 'What is said in ' || a.qid AS text, coalesce(ids, '') AS evidence, coalesce(n, 0)::INTEGER AS hop_count FROM (SELECT DISTINCT conv_id::VARCHAR AS qid FROM conversations) a LEFT JOIN e ON e.qid = a.qid"
)
def dataset_paragraph_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.normalize_paragraph_qa(paragraph_questions(spark, sf_dir))[1].select("qid", "text", F.array_join("evidence.url", "|").alias("evidence"), "hop_count")


@query("SELECT doc_id::VARCHAR AS doc_id, lang, md5(concat_ws(' ', doc_id::VARCHAR, coalesce(text, ''), coalesce(lang, ''), coalesce(source, ''))) AS digest FROM documents")
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, written as CSV files and read again; a file is one task's, so larger tables have more files, not larger ones."""
    path = scratch_path(spark, "csv")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows.write.options(header=True, maxRecordsPerFile=1000, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(path)
    read = files.read_files(spark, path)
    return read.select(F.col("metadata")["doc_id"].alias("doc_id"), F.nullif(F.col("metadata")["lang"], F.lit("")).alias("lang"), F.md5("text").alias("digest"))


# --- chunks, extraction, graph ----------------------------------------------------------------------------


@query(f"WITH {_UNITS} SELECT id, document_id, position::INTEGER AS position, text, token_count FROM units")
def chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units_of(spark, sf_dir).select("id", "document_id", "position", "text", "token_count")


@query(f"WITH s AS (SELECT doc_id, unnest({sents('text')}) AS x FROM documents), a AS (SELECT doc_id, x, {when_chain('x')} AS relation FROM s) SELECT relation, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM a GROUP BY relation")
def extract_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(t.sentences(F.col("text"))).alias("x"))
    return s.groupBy(r.relation_of(F.col("x"))["name"].alias("relation")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"WITH {_ROWS} SELECT unit_id, document_id, position::INTEGER AS position, k::INTEGER AS k, source, target, relation, ontology_ok, evidence, evidence_type, llm_conf FROM rel_rows")
def extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.relation_rows(units_of(spark, sf_dir))
    return rows.select("unit_id", "document_id", "ord.position", "ord.k", "source", "target", "relation", "ontology_ok", "evidence", "evidence_type", "llm_conf")


@query(f"WITH {_EDGES} SELECT id, source, target, relation, weight, evidence_text, evidence_type, llm_conf, edge_text, combined_degree, array_to_string(text_unit_ids, '|') AS text_unit_ids, array_to_string(source_docs, '|') AS source_docs FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = extraction.with_combined_degree(extraction.merge_edges(extraction.relation_rows(units_of(spark, sf_dir))))
    return edges.select("id", "source", "target", "relation", "weight", "evidence_text", "evidence_type", "llm_conf", "edge_text", "combined_degree", listed("text_unit_ids"), listed("source_docs"))


_ENTITIES = f"""{_EDGES},
ment AS (SELECT ord * 2 + e AS pos, unit_id, evidence, CASE WHEN e = 0 THEN source ELSE target END AS name FROM rel_rows, (SELECT unnest([0, 1]) AS e)),
spelled AS (SELECT name, list_sort(list_distinct(list(unit_id))) AS text_unit_ids, arg_min(evidence, pos) AS description, min(pos) AS pos FROM ment GROUP BY name),
ents AS (SELECT {cf('name')} AS key, arg_min(name, pos) AS title, arg_min(text_unit_ids, pos) AS text_unit_ids, arg_min(description, pos) AS description, min(pos) AS pos FROM spelled GROUP BY 1),
entities AS (SELECT {sid('ent', 'key')} AS id, e.title, description, text_unit_ids, coalesce(degree, 0) AS degree, pos FROM ents e LEFT JOIN deg d ON d.title = e.title)"""


@query(f"WITH {_ENTITIES} SELECT id, title, description, degree, array_to_string(text_unit_ids, '|') AS text_unit_ids FROM entities")
def graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(extraction.relation_rows(units_of(spark, sf_dir)), "rows")  # read three times
    return extraction.merge_entities(rows, extraction.merge_edges(rows)).select("id", "title", "description", "degree", listed("text_unit_ids"))


@query(f"WITH {_CAL} SELECT id, evidence_score, ontology_score, structural_score, consistency_score, conflict_status, reliability FROM cal")
def calibrate_text_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = extraction.with_combined_degree(extraction.merge_edges(extraction.relation_rows(units_of(spark, sf_dir))))
    return calibration.calibrate_edges(edges).select("id", "evidence_score", "ontology_score", "structural_score", "consistency_score", "conflict_status", "reliability")


@query(
    f"""WITH {_ROWS},
told AS (
  SELECT r.*, source || CASE WHEN k % 2 = 1 THEN '.' ELSE '' END AS s0, target || CASE WHEN k % 3 = 1 THEN '-' ELSE '' END AS t0, u.text AS unit FROM rel_rows r JOIN units u ON u.id = r.unit_id),
ends AS (SELECT *, row_number() OVER (ORDER BY document_id, position, k, e) AS o FROM (SELECT document_id, position, k, 0 AS e, s0 AS name FROM told UNION ALL SELECT document_id, position, k, 1, t0 FROM told)),
canon AS (SELECT {ekey('name')} AS key, arg_min(name, o) AS name FROM ends GROUP BY 1),
spelled AS (
  SELECT t.*, a.name AS sn, b.name AS tn, a.name || ' ' || replace(relation, '_', ' ') || ' ' || b.name AS plain FROM told t JOIN canon a ON a.key = {ekey('s0')} JOIN canon b ON b.key = {ekey('t0')} WHERE a.key <> '' AND b.key <> '')
SELECT unit_id, document_id, sn AS source, tn AS target, relation, TRUE AS ontology_ok, 'explicit' AS evidence_type, CASE WHEN k % 2 = 0 THEN 0.75 ELSE 0.6 END::DOUBLE AS llm_conf,
       md5(CASE WHEN k % 2 = 0 THEN evidence WHEN contains({cf('unit')}, {cf('plain')}) THEN plain ELSE unit END) AS evidence
FROM spelled WHERE sn <> tn"""
)
def extract_payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in the form of a service, made of the rules' rows: names in other spellings, odd evidence, confidence 0; checked and merged into rows."""
    units = materialize(units_of(spark, sf_dir), "units")
    k = F.col("ord.k")
    name = lambda c, n, mark: F.concat(c, F.when(k % n == 1, mark).otherwise(""))
    told = F.struct(
        k.alias("k"), name("source", 2, ".").alias("source"), name("target", 3, "-").alias("target"), F.replace("relation", F.lit("_"), F.lit(" ")).alias("relation"),
        F.when(k % 2 == 0, F.col("evidence")).otherwise("never said in any text").alias("evidence_text"), F.when(k % 2 == 0, 0.0).otherwise(0.6).alias("confidence"),
    )
    empty = F.struct(F.lit(-1).alias("k"), F.lit("a name without a partner").alias("source"), F.lit("").alias("target"), F.lit("uses").alias("relation"), F.lit("").alias("evidence_text"), F.lit(0.9).alias("confidence"))
    each = extraction.relation_rows(units).groupBy("unit_id").agg(F.sort_array(F.collect_list(told)).alias("rows"))
    answers = each.select("unit_id", F.to_json(F.struct(F.array().cast("array<struct<name:string>>").alias("entities"), F.concat("rows", F.array(empty)).alias("relationships"))).alias("answer"), F.lit(None).cast("string").alias("error"))
    found = enrichment.payload_rows(enrichment.validate_payload(answers).where("error is null"), units)
    return found.select("unit_id", "document_id", "source", "target", "relation", "ontology_ok", "evidence_type", "llm_conf", F.md5("evidence").alias("evidence"))


# a graph of trade: suppliers deliver parts, customers come from nations


def plain_trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey", F.col("l_returnflag").alias("flag")).agg(F.count("*").cast("double").alias("weight"), F.min("l_orderkey").alias("doc"))
    made = lines.select(
        F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.when(F.col("flag") == "R", "produces").when(F.col("flag") == "A", "uses").otherwise("hosts").alias("relation"), "weight", F.array("doc").alias("source_docs")
    )
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("source"), F.concat(F.lit("b"), "p_brand").alias("target"), F.lit("part_of").alias("relation"), F.lit(1.0).alias("weight"), F.array("p_partkey").alias("source_docs"))
    return described_trade(made.unionByName(parts))


def described_trade(edges: DataFrame) -> DataFrame:
    """``edges`` with what follows from their source, target and relation, for those who have dealt them before."""
    told = {"evidence_text": F.concat_ws(" ", "source", "relation", "target"), "id": t.stable_id("edge", F.col("source"), F.col("target"), F.col("relation"))}
    return edges.withColumns(told | {"evidence_type": F.lit("table"), "llm_conf": F.lit(0.8), "ontology_ok": F.lit(True), "conflict_status": F.lit("ok")})


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.with_combined_degree(plain_trade_edges(spark, sf_dir))


def calibrated_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated edges.  They are dealt narrow: written once before their degrees are counted and once with these; ids are made at the end."""
    plain = materialize(plain_trade_edges(spark, sf_dir).select("source", "target", "relation", "source_docs"), "trade")
    edges = materialize(extraction.with_combined_degree(plain), "degrees")
    return described_trade(calibration.calibrate_edges(described_trade(edges).drop("id")))


_TRADE = f"""lines AS (SELECT l_suppkey, l_partkey, count(*)::DOUBLE AS weight, min(l_orderkey) AS doc, l_returnflag AS flag FROM lineitem GROUP BY l_suppkey, l_partkey, l_returnflag),
trade0 AS (
  SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, CASE flag WHEN 'R' THEN 'produces' WHEN 'A' THEN 'uses' ELSE 'hosts' END AS relation, weight, [doc] AS source_docs FROM lines
  UNION ALL SELECT 'p' || p_partkey, 'b' || p_brand, 'part_of', 1.0::DOUBLE, [p_partkey] FROM part),
trade1 AS (SELECT *, source || ' ' || relation || ' ' || target AS evidence_text, {sid('edge', 'source', 'target', 'relation')} AS id FROM trade0),
tdeg AS (SELECT title, count(*) AS degree FROM (SELECT unnest([source, target]) AS title FROM trade1) GROUP BY 1),
trade AS (SELECT e.*, a.degree + b.degree AS combined_degree FROM trade1 e JOIN tdeg a ON a.title = e.source JOIN tdeg b ON b.title = e.target)"""


@query(f"WITH {_TRADE} SELECT title, degree FROM tdeg")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.degrees(trade_edges(spark, sf_dir))


_TRADE_CAL = f"""{_TRADE},
tc0 AS (
  SELECT *, count(*) OVER (PARTITION BY relation) AS rel_n, count(*) OVER () AS n, max(combined_degree) OVER () AS max_cd,
         count(*) OVER (PARTITION BY {cf('source')}, {cf('target')}) - count(*) OVER (PARTITION BY {cf('source')}, {cf('target')}, relation) AS conflicts,
         list_distinct({ctok("source || ' ' || target || ' ' || relation")}) AS alias, {ctok('evidence_text')} AS ev FROM trade),
tc AS (
  SELECT *, {_CLIP.format("0.4 * 0.8::DOUBLE + 0.3 * (len(list_intersect(alias, list_distinct(ev))) / greatest(1, len(alias))::DOUBLE) + 0.2 * 0.7::DOUBLE + 0.1 * 0.5::DOUBLE")} AS evidence_score,
         {_CLIP.format('0.55 * (ln(1 + combined_degree) / ln(1 + max_cd)) + 0.45 * (ln(1 + rel_n) / ln(1 + greatest(1, n)))')} AS structural_score,
         {_CLIP.format('1.0 - least(0.75, 0.25 * conflicts)::DOUBLE')} AS consistency_score FROM tc0),
trade_cal AS (SELECT *, {_CLIP.format('0.35 * evidence_score + 0.25 + 0.2 * structural_score + 0.2 * consistency_score')} AS reliability FROM tc)"""


@query(f"WITH {_TRADE_CAL} SELECT id, evidence_score, structural_score, consistency_score, reliability FROM trade_cal")
def calibrate_trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrated_trade(spark, sf_dir).select("id", "evidence_score", "structural_score", "consistency_score", "reliability")


@query(f"WITH {_TRADE} SELECT a.id AS first, b.id AS second, a.source, a.target AS via, b.target FROM trade a JOIN trade b ON a.target = b.source AND a.id <> b.id AND a.source <> b.target AND a.target <> b.target")
def graph_two_hop_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = materialize(plain_trade_edges(spark, sf_dir).select("id", "source", "target"), "trade")
    return graph.two_hop_paths(edges)


@query(f"WITH {_TRADE_CAL} , g AS (SELECT {cf('source')} AS source_key, {cf('target')} AS target_key, list_sort(list(id)) AS ids, count(*) AS n FROM trade GROUP BY 1, 2 HAVING count(*) >= 2) SELECT source_key, target_key, array_to_string(ids, '|') AS edge_ids, n FROM g")
def graph_contradiction_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.contradiction_groups(trade_edges(spark, sf_dir)).select("source_key", "target_key", listed("edge_ids"), "n")


@query(
    f"""WITH {_TRADE_CAL}, t1 AS (SELECT *, row_number() OVER (ORDER BY id) AS o FROM trade_cal),
nx AS (SELECT id AS next_id, {cf('source')} AS node, row_number() OVER (PARTITION BY {cf('source')} ORDER BY o, id) AS n FROM t1),
j AS (SELECT a.id AS seed_id, b.next_id, row_number() OVER (ORDER BY a.reliability DESC, a.o, a.id, b.n) AS k FROM t1 a JOIN nx b ON {cf('a.target')} = b.node AND b.n <= 5)
SELECT seed_id, next_id, k::INTEGER AS k FROM j WHERE k <= 200"""
)
def graph_inference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):  # what is written on the way goes before the pairs are made
        edges = materialize(calibrated_trade(spark, sf_dir).select("id", "source", "target", "reliability"), "edges", keep=True)
    return graph.inference_pairs(edges.withColumn("ord", F.col("id")))


@query(
    f"""WITH {_TRADE.replace('trade1 AS (', 'trade1 AS MATERIALIZED (').replace('tdeg AS (', 'tdeg AS MATERIALIZED (')},
nodes AS MATERIALIZED (SELECT title, degree FROM tdeg ORDER BY degree DESC, title LIMIT 200)
SELECT id, source, target FROM trade1 e JOIN nodes a ON a.title = e.source JOIN nodes b ON b.title = e.target"""
)
def graph_top_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = materialize(trade_edges(spark, sf_dir), "trade")
    names = edges.select(F.explode(F.array("source", "target")).alias("title")).distinct()
    return graph.top_subgraph(names, edges, 200)[1].select("id", "source", "target")


@query(
    f"""WITH RECURSIVE {_EDGES}, ends2 AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
walk(node, low) AS (SELECT a, a FROM ends2 UNION SELECT b.b, w.low FROM walk w JOIN ends2 b ON b.a = w.node AND w.low < b.b)
SELECT node, min(low) AS component FROM walk GROUP BY node"""
)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = extraction.merge_edges(extraction.relation_rows(units_of(spark, sf_dir)))
    return graph.connected_components(materialize(edges.select("source", "target"), "edges"))  # read twice


@query()
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = small_index(spark, sf_dir, True)
    return found.communities.select("id", listed("entity_ids"), listed("edge_ids"), "level")


@query()
def graph_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = small_index(spark, sf_dir, True)
    return found.reports.select("id", "community_id", "title", "summary", listed("edge_ids"), "reliability")


# --- scoring and ranking ----------------------------------------------------------------------------------

_BODY = f"WITH {_QUERIES}, d AS (SELECT doc_id AS id, text FROM documents),{posts_sql('d', ['id'], 'b')}, {terms_sql('q', ['qid'], 'qt')},{bm25_sql('b_p', 'b_st', 'qt', ['qid'], [], ['id'])}"
_TOP = (
    "{}, pool AS (SELECT qid, id, score FROM bm UNION ALL SELECT qid, id, 0.0 FROM q, (SELECT id FROM d ORDER BY id LIMIT {k})), "
    "best AS (SELECT qid, id, max(score) AS score FROM pool GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM best) "
    "SELECT qid, id, score, rank::INTEGER AS rank FROM ranked WHERE rank <= {k}"
)


def bm25_top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), t.content_tokens(F.col("text")).alias("tokens"))
    return scoring.filled_top_k(materialize(docs, "bodies"), asked(spark, sf_dir), ["qid"], k)


@query(_TOP.format(_BODY, k=80))
def rank_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_top(spark, sf_dir, 80)


@query(
    "WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v), "
    "s AS (SELECT a.id AS query_id, b.id, round(greatest(0.0, list_dot_product(a.e, b.e)), 9) AS score FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 50 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s) SELECT query_id, id, round(score, 6) AS score FROM r WHERE n <= 10"
)
def rank_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return scoring.vector_top_k(v.where("id % 50 = 0"), v).select("query_id", "id", F.round("score", 6).alias("score"))


@query()
def rank_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return scoring.dense_top_k(asked(spark, sf_dir), docs, ["qid"], 80)


_PLAIN = Settings(use_dense=False, use_enrichment=False)
_LISTS = f"""WITH {_QUERIES}, {_UNITS},
bodies AS (
  SELECT d.id, title || '. ' || coalesce(string_agg(u.text, ' ' ORDER BY position), any_value(d.text), '') AS text FROM docs d LEFT JOIN units u ON u.document_id = d.id GROUP BY d.id, title),
fields AS (
  SELECT 'title' AS field, id, title AS text FROM docs UNION ALL SELECT 'body', id, text FROM bodies
  UNION ALL SELECT 'metadata', id, array_to_string(list_filter([title, source, category], lambda x: coalesce(x, '') <> ''), ' ') FROM docs),
subs0 AS (SELECT qid, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS w FROM q),
subs1 AS (SELECT *, list_transform(string_split_regex(w, '(?i){_SPLIT}'), lambda p: regexp_replace(p, '^[ ,.?]+|[ ,.?]+$', '', 'g')) AS p, {cf("regexp_replace(w, '^[ ,.?]+|[ ,.?]+$', '', 'g')")} AS wk FROM subs0),
subs2 AS (SELECT qid, w, wk, unnest(list_transform(list_zip(range(len(p)), p), lambda z: {{'k': z[1], 'p': z[2]}})) AS z FROM subs1),
subs3 AS (SELECT qid, z.p AS text, row_number() OVER (PARTITION BY qid ORDER BY z.k) AS sub FROM subs2 WHERE len({ctok('z.p')}) >= 4 AND {cf('z.p')} <> wk),
subs AS (SELECT qid, 0 AS sub, w AS text FROM subs0 WHERE w <> '' UNION ALL SELECT qid, sub, text FROM subs3 WHERE sub <= 3),{posts_sql('fields', ['field', 'id'], 'f')}, {terms_sql('subs', ['qid', 'sub'], 'qt')},{bm25_sql('f_p', 'f_st', 'qt', ['qid', 'sub'], ['field'], ['id'])},
pool AS (
  SELECT qid, sub, field, id, score FROM bm
  UNION ALL SELECT qid, sub, field, id, 0.0 FROM subs, (SELECT unnest(['title', 'body', 'metadata', 'dense']) AS field), (SELECT id FROM docs ORDER BY id LIMIT 80)),
best AS (SELECT qid, sub, field, id, max(score) AS score FROM pool GROUP BY ALL),
lists AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, sub, field ORDER BY score DESC, id) AS rank FROM best) WHERE rank <= 80)"""


@query(f"{_LISTS} SELECT qid, sub::INTEGER AS sub, field, id, score, rank::INTEGER AS rank FROM lists")
def rank_field_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(test_documents(spark, sf_dir), with_communities=False, keep_graph=False)  # no list here reads the graph
    return ranking.ranked_lists(index, asked(spark, sf_dir), _PLAIN).select("qid", "sub", "field", "id", "score", "rank")


def ranking_index(spark: SparkSession, sf_dir: str) -> Index:
    return small_index(spark, sf_dir)


_FIRST = f"""{_LISTS.replace(f'WITH {_QUERIES}, {_UNITS}', f'WITH {_QUERIES}, {_CAL}')},
clause AS (
  SELECT qid, sub, id, sum(CASE field WHEN 'title' THEN 1.25 WHEN 'body' THEN 1.0 WHEN 'metadata' THEN 0.8 ELSE 0.75 END::DOUBLE / (60 + rank)) AS rrf,
         max(CASE WHEN field IN ('title', 'body') THEN score END) AS bm25, max(CASE WHEN field = 'metadata' THEN score END) AS metadata, max(score) AS clause
  FROM lists GROUP BY ALL),
fused0 AS (SELECT qid, id, sum(rrf) AS rrf, max(bm25) AS bm25, max(metadata) AS metadata, count(*) FILTER (clause >= 0.2) AS covered FROM clause GROUP BY ALL),
fused AS (SELECT * EXCLUDE (rrf), round(rrf / max(rrf) OVER (PARTITION BY qid), 9) AS rrf FROM fused0),
rel AS (SELECT id, round(avg(reliability), 9) AS reliability FROM (SELECT unnest(source_docs) AS id, reliability FROM cal) GROUP BY 1),
meta AS (SELECT id, list_distinct({ctok('text')}) AS m FROM fields WHERE field = 'metadata'),
match AS (SELECT qid, id, round(len(list_intersect(m, list_distinct(qk))) / len(m)::DOUBLE, 9) AS metadata_match FROM meta, (SELECT qid, {ctok('text')} AS qk FROM q) WHERE len(m) > 0),
nsub AS (SELECT qid, count(*) AS n_sub FROM subs GROUP BY 1),
full0 AS (
  SELECT n.qid, d.id, coalesce(rrf, 0.0) AS rrf, coalesce(bm25, 0.0) AS bm25, greatest(coalesce(metadata, 0.0), coalesce(metadata_match, 0.0)) AS metadata,
         coalesce(covered, 0) / n_sub::DOUBLE AS coverage, coalesce(reliability, 0.0) AS reliability
  FROM nsub n CROSS JOIN docs d LEFT JOIN fused f ON f.qid = n.qid AND f.id = d.id LEFT JOIN match m ON m.qid = n.qid AND m.id = d.id LEFT JOIN rel r ON r.id = d.id),
full1 AS (SELECT *, floor((0.45::DOUBLE * rrf + 0.2::DOUBLE * bm25 + 0.07::DOUBLE * coverage + 0.02::DOUBLE * metadata + 0.01::DOUBLE * reliability) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE AS first_score FROM full0),
first_stage AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_score DESC, id) AS rank FROM full1) WHERE rank <= 80)"""


@query(f"{_FIRST} SELECT qid, id, rank::INTEGER AS rank, first_score, rrf, bm25, round(coverage, 6) AS coverage, metadata, reliability FROM first_stage")
def rank_first_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.first_stage(ranking_index(spark, sf_dir), asked(spark, sf_dir), _PLAIN)
    return found.select("qid", "id", "rank", "first_score", "rrf", "bm25", rounded(F.col("coverage")).alias("coverage"), "metadata", "reliability")


@query(f"WITH {_EDGES} SELECT id, CASE WHEN relation IN ('causes', 'prevents', 'depends_on') THEN 'causal|diagnostic' WHEN relation IN ('located_in', 'part_of') THEN 'factual|structural' ELSE 'factual|exploratory' END AS useful_for FROM edges")
def rule_useful_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.merge_edges(extraction.relation_rows(units_of(spark, sf_dir))).select("id", listed("useful_for"))


@query(f"WITH {_CAL}, rel AS (SELECT id, avg(reliability) AS r, 0.5::DOUBLE AS i FROM (SELECT unnest(source_docs) AS id, reliability FROM cal) GROUP BY 1) SELECT d.id, round(coalesce(r, 0.0), 9) AS reliability, coalesce(i, 0.0) AS importance FROM docs d LEFT JOIN rel ON rel.id = d.id")
def rank_document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.document_features(ranking_index(spark, sf_dir), Settings(), True).select("id", "reliability", "importance")


@query(
    f"WITH {_QUERIES}, {_UNITS}, meta AS (SELECT id, list_distinct({ctok("array_to_string(list_filter([title, source, category], lambda x: coalesce(x, '') <> ''), ' ')")}) AS m FROM docs) "
    f"SELECT qid, id, round(len(list_intersect(m, list_distinct(qk))) / len(m)::DOUBLE, 9) AS metadata_match FROM meta, (SELECT qid, {ctok('text')} AS qk FROM q) WHERE len(list_intersect(m, list_distinct(qk))) > 0"
)
def rank_metadata_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(test_documents(spark, sf_dir), with_communities=False, cut=False)  # only its documents are read
    return ranking.metadata_match(index, asked(spark, sf_dir))


@query(f"{_TOP.format(_BODY, k=10).replace('SELECT qid, id, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10', '')} SELECT q.qid, coalesce(max(score) FILTER (rank = 1), 0.0) < 0.3::DOUBLE AS abstained FROM q LEFT JOIN ranked r ON r.qid = q.qid GROUP BY 1")
def rank_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.abstains(bm25_top(spark, sf_dir, 10), asked(spark, sf_dir), Settings())


_PACKED = f"""{_TOP.format(_BODY.replace('WITH q AS', 'WITH RECURSIVE q AS', 1), k=10).replace('SELECT qid, id, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10', '')},
said AS (
  SELECT r.qid, r.id, r.rank, {trimmed("array_to_string((" + wds('d.text') + ")[1:12], ' ') || '. ' || d.text")} AS text FROM ranked r JOIN d ON d.id = r.id WHERE r.rank <= 10),
sized AS MATERIALIZED (SELECT *, {est('text')} AS n, {wds('text')} AS w FROM said),
fill AS (
  SELECT qid, 0::BIGINT AS rank, 1200::BIGINT AS left_, 0::BIGINT AS place, NULL::BIGINT AS id, NULL::VARCHAR AS text, 0::BIGINT AS n FROM q
  UNION ALL
  SELECT qid, rank, CASE WHEN fits THEN left_ - m ELSE left_ END, CASE WHEN fits THEN place + 1 ELSE place END, CASE WHEN fits THEN id END, part, m FROM (
    SELECT *, part <> '' AND m <= left_ AS fits FROM (
      SELECT *, {est('part')} AS m FROM (
        SELECT f.qid, s.rank, f.left_, f.place, s.id, CASE WHEN s.n <= f.left_ THEN s.text WHEN f.left_ <= 0 THEN '' ELSE array_to_string(s.w[1:greatest(1, floor(f.left_ / 1.25)::BIGINT)], ' ') END AS part
        FROM fill f JOIN sized s ON s.qid = f.qid AND s.rank = f.rank + 1))))"""


@query(f"{_PACKED} SELECT qid, place::INTEGER AS place, id::VARCHAR AS item, md5(text) AS text, n AS token_count FROM fill WHERE id IS NOT NULL")
def context_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of each query, whole, packed into the token budget; what doesn't fit is cut to what is left."""
    docs = test_documents(spark, sf_dir).select("id", "title", F.col("text").alias("snippet"))
    ranked = bm25_top(spark, sf_dir, 10).join(docs, "id")
    return context.pack_documents(ranked, 1200).select("qid", "place", "item", F.md5("text").alias("text"), "token_count")


_SNIPPETS = f"""{_FIRST},
wu AS (SELECT u.document_id AS id, position, u.text FROM units u WHERE u.document_id IN (SELECT id FROM first_stage)),{posts_sql('wu', ['id', 'position'], 'w')},
wt AS (SELECT t.*, f.id FROM (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({ctok('text')}) AS term FROM q) GROUP BY ALL) t JOIN first_stage f ON f.qid = t.qid),{bm25_sql('w_p', 'w_st', 'wt', ['qid', 'id'], ['id'], ['position'], 'sn')},
sbest AS (SELECT qid, id, arg_min(position, {{'a': -score, 'b': position}}) AS position FROM sn GROUP BY ALL),
snip AS (
  SELECT f.qid, f.id, coalesce(b.position, 0) AS position, array_to_string(({wds('coalesce(u.text, d.text)')})[1:144], ' ') AS snippet, d.title
  FROM first_stage f LEFT JOIN sbest b ON b.qid = f.qid AND b.id = f.id LEFT JOIN units u ON u.document_id = f.id AND u.position = coalesce(b.position, 0) JOIN docs d ON d.id = f.id)"""


@query(f"{_SNIPPETS} SELECT qid, id, md5(snippet) AS snippet FROM snip")
def rank_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = ranking_index(spark, sf_dir), asked(spark, sf_dir)
    first = materialize(ranking.first_stage(index, queries, _PLAIN).select("qid", "id"), "first")
    return ranking.best_snippets(index, queries, first).select("qid", "id", F.md5("snippet").alias("snippet"))


_COVERAGE = f"""{_SNIPPETS.replace('WITH q AS', 'WITH RECURSIVE q AS', 1)},
near AS (
  SELECT f.*, snippet, CASE WHEN f.rank <= 40 THEN round({counted_cosine('a', 'b')}, 9) ELSE 0.0 END AS reranker
  FROM (SELECT f.*, s.snippet, {ctok('q.text')} AS a, {ctok("s.title || '. ' || s.snippet")} AS b FROM first_stage f JOIN snip s ON s.qid = f.qid AND s.id = f.id JOIN q ON q.qid = f.qid) f),
said AS (
  SELECT n.qid, n.id, list(coalesce(c.clause, 0.0) ORDER BY s.sub) AS told
  FROM first_stage n JOIN subs s ON s.qid = n.qid LEFT JOIN clause c ON c.qid = n.qid AND c.id = n.id AND c.sub = s.sub GROUP BY 1, 2),
cand AS MATERIALIZED (
  SELECT n.qid, n.id, n.snippet, told, floor((0.45::DOUBLE * rrf + 0.2::DOUBLE * bm25 + 0.1::DOUBLE * reranker + 0.07::DOUBLE * coverage + 0.02::DOUBLE * metadata + 0.01::DOUBLE * reliability) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS score
  FROM near n JOIN said s ON s.qid = n.qid AND s.id = n.id),
pick AS (
  SELECT qid, 1 AS rank, b.id AS id, b.told AS covered, [b.id] AS used FROM (SELECT qid, arg_max({{'id': id, 'told': told}}, {{'s': score, 'i': id}}) AS b FROM cand GROUP BY qid)
  UNION ALL
  SELECT qid, rank + 1, b.id, list_transform(list_zip(covered, b.told), lambda z: greatest(z[1], z[2])), list_append(used, b.id) FROM (
    SELECT p.qid, p.rank, p.covered, p.used, arg_max({{'id': c.id, 'told': c.told}}, {{'s': floor((c.score + 0.08::DOUBLE * list_sum(list_transform(list_zip(c.told, p.covered), lambda z: greatest(0.0, z[1] - z[2])))) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE, 'i': c.id}}) AS b
    FROM pick p JOIN cand c ON c.qid = p.qid WHERE p.rank < 10 AND NOT list_contains(p.used, c.id) GROUP BY ALL))"""


@query(f"{_COVERAGE} SELECT p.qid, p.id, p.rank, c.score, md5(c.snippet) AS snippet FROM pick p JOIN cand c ON c.qid = p.qid AND c.id = p.id")
def rank_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stages without a dense list and enrichment: lexical reranking and the order by coverage."""
    found = ranking.rank_documents(ranking_index(spark, sf_dir), asked(spark, sf_dir), _PLAIN)
    return found.select("qid", "id", "rank", "score", F.md5("snippet").alias("snippet"))


@query()
def rank_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.rank_documents(small_index(spark, sf_dir), asked(spark, sf_dir))
    return found.select("qid", "id", "rank", "score", "snippet")


_EXPANDED = (
    _FIRST.replace("FROM docs),\nsubs0", "FROM docs\n  UNION ALL SELECT 'graph', d.id, coalesce(g.text, '') FROM docs d LEFT JOIN (SELECT id, string_agg(edge_text, ' ') AS text FROM (SELECT unnest(source_docs) AS id, edge_text FROM cal) GROUP BY 1) g ON g.id = d.id),\nsubs0")
    .replace("unnest(['title', 'body', 'metadata', 'dense'])", "unnest(['title', 'body', 'metadata', 'graph', 'dense'])")
    .replace("WHEN 'metadata' THEN 0.8 ELSE 0.75 END", "WHEN 'metadata' THEN 0.8 WHEN 'graph' THEN 0.2 ELSE 0.75 END")
    .replace("AS metadata, max(score) AS clause", "AS metadata, max(CASE WHEN field = 'graph' THEN score END) AS graph, max(score) AS clause")
    .replace("max(metadata) AS metadata, count(*) FILTER", "max(metadata) AS metadata, max(graph) AS graph, count(*) FILTER")
    .replace("coalesce(bm25, 0.0) AS bm25, greatest", "coalesce(bm25, 0.0) AS bm25, coalesce(graph, 0.0) AS graph, CASE WHEN r.id IS NULL THEN 0.0 ELSE 0.5 END::DOUBLE AS importance, greatest")
)
_EXPANDED = f"""{_EXPANDED[: _EXPANDED.index('full1 AS (')]}
base AS (SELECT *, 0.45::DOUBLE * rrf + 0.2::DOUBLE * bm25 + 0.07::DOUBLE * coverage + 0.02::DOUBLE * metadata + 0.01::DOUBLE * graph AS lead FROM full0),
seed AS (
  SELECT qid, id, s FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS n FROM (
    SELECT qid, id, floor((lead + 0.01::DOUBLE * reliability + 0.02::DOUBLE * importance) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE AS s FROM base)) WHERE n <= 10),
ends1 AS (SELECT DISTINCT id, {cf('e')} AS entity FROM (SELECT id, unnest([source, target]) AS e FROM (SELECT unnest(source_docs) AS id, source, target FROM cal)) WHERE len({ctok('e')}) > 0),
bridge AS (
  SELECT s.qid, entity, max(s) AS w FROM seed s JOIN ends1 e ON e.id = s.id JOIN (SELECT qid, {ctok('text')} AS qk FROM q) a ON a.qid = s.qid
  WHERE NOT (len({ctok('entity')}) > 0 AND len(list_filter({ctok('entity')}, lambda z: NOT list_contains(qk, z))) = 0) GROUP BY 1, 2),
lift AS (SELECT qid, id, sum(w) AS raw FROM bridge b JOIN ends1 e ON e.entity = b.entity GROUP BY 1, 2),
lifted AS (SELECT qid, id, round(raw / best, 9) AS graph_expansion FROM (SELECT *, max(raw) OVER (PARTITION BY qid) AS best FROM lift) WHERE best > 0),
full1 AS (
  SELECT b.*, coalesce(graph_expansion, 0.0) AS graph_expansion,
         floor((lead + 0.08::DOUBLE * coalesce(graph_expansion, 0.0) + 0.01::DOUBLE * reliability + 0.02::DOUBLE * importance) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE AS first_score
  FROM base b LEFT JOIN lifted l ON l.qid = b.qid AND l.id = b.id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_score DESC, id) AS rank FROM full1)"""


@query(f"{_EXPANDED} SELECT qid, id, rank::INTEGER AS rank, graph, graph_expansion, first_score FROM ordered WHERE rank <= 80")
def rank_graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = Settings(use_dense=False, use_graph=True, use_graph_expansion=True)
    return ranking.first_stage(small_index(spark, sf_dir), asked(spark, sf_dir), config).select("qid", "id", "rank", "graph", "graph_expansion", "first_score")


@query()
def retrieve_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterative.retrieve_iterative(small_index(spark, sf_dir), asked(spark, sf_dir)).select("qid", "id", "rank", "score")


@query()
def retrieve_hybrid_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context.candidate_context(small_index(spark, sf_dir, True), asked(spark, sf_dir), "hybrid")
    return found.select("qid", "place", "kind", "item", "score", "token_count")


@query()
def retrieve_document_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = small_index(spark, sf_dir, True), asked(spark, sf_dir)
    ranked = materialize(ranking.rank_documents(index, queries, Settings(use_dense=False)).select("qid", "id", "rank", "score", "title", "snippet"), "ranked")
    return context.document_context(index, queries, ranked).select("qid", "place", "kind", "item", "token_count")


# --- evaluation -------------------------------------------------------------------------------------------


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions; evidence: the documents that contain them."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pid"), "text")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = evaluation.containing(b, d).groupBy(F.col("pid").alias("qid")).agg(F.sort_array(F.collect_list(F.col("id").cast("string"))).alias("ids"))
    q = asked(spark, sf_dir).join(hits, "qid", "left")
    proof = F.transform(F.coalesce("ids", F.array().cast("array<string>")), lambda i: F.struct(i.alias("url"), F.lit(None).cast("string").alias("title")))
    return q.select("qid", "text", F.lit("that").alias("answer"), proof.alias("evidence"), F.when(F.col("qid") % 2 == 0, "even").otherwise("odd").alias("question_type"))


_GOLD = "gold AS (SELECT b.item_id AS qid, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {_GOLD} SELECT qid, id FROM gold")
def evaluate_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("url"), F.lit("t").alias("title"))
    return evaluation.gold_documents(questions(spark, sf_dir), docs)


@query(f"WITH {_GOLD}, n AS (SELECT qid, count(*) AS c FROM gold GROUP BY 1) SELECT item_id AS qid, coalesce(c, 0)::INTEGER AS expected, coalesce(c, 0) AS found, CASE WHEN c IS NULL THEN 'null' ELSE 'evaluated' END AS status FROM benchmark LEFT JOIN n ON qid = item_id")
def evaluate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("url"), F.lit("t").alias("title"))
    qa = materialize(questions(spark, sf_dir), "qa")
    return evaluation.evidence_status(qa, evaluation.gold_documents(qa, docs))


_EVAL = f"""{_BODY}, pool AS (SELECT qid, id, score FROM bm UNION ALL SELECT qid, id, 0.0 FROM q, (SELECT id FROM d ORDER BY id LIMIT 10)),
best AS (SELECT qid, id, max(score) AS score FROM pool GROUP BY 1, 2), ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM best) WHERE rank <= 10),
{_GOLD}, ng AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY 1),
h AS (SELECT r.qid, r.rank, g.id IS NOT NULL AS hit FROM ranked r LEFT JOIN gold g ON g.qid = r.qid AND g.id = r.id),
per AS (SELECT qid, count(*) AS n_seen, count(*) FILTER (hit) AS n_hit, min(rank) FILTER (hit) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (hit), 0.0) AS dcg FROM h GROUP BY 1),
m AS (
  SELECT qid, n_hit / n_gold::DOUBLE AS recall_at_k, n_hit / greatest(1, n_seen)::DOUBLE AS precision_at_k, coalesce(1.0 / first, 0.0) AS mrr,
         dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_at_k, (n_hit = n_gold)::INTEGER::DOUBLE AS all_evidence_success_at_k FROM ng JOIN per USING (qid))"""


def bm25_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("url"), F.lit("t").alias("title"))
    gold = materialize(evaluation.gold_documents(questions(spark, sf_dir), docs), "gold")
    places = bm25_top(spark, sf_dir, 10).select("qid", "rank", F.array("id").alias("ids"))
    return evaluation.question_metrics(places, gold, 10)


@query(f"{_EVAL} SELECT qid, round(recall_at_k, 6) AS recall_at_k, round(precision_at_k, 6) AS precision_at_k, round(mrr, 6) AS mrr, round(ndcg_at_k, 6) AS ndcg_at_k, all_evidence_success_at_k FROM m")
def evaluate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25_metrics(spark, sf_dir)
    return found.select("qid", *[rounded(F.col(c)).alias(c) for c in ("recall_at_k", "precision_at_k", "mrr", "ndcg_at_k")], "all_evidence_success_at_k")


@query(f"{_EVAL} SELECT qid, round(recall_at_k, 6) AS packed_context_recall_at_k FROM m")
def evaluate_packed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the gold documents among the documents of a context of the ten best."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("url"), F.lit("t").alias("title"))
    gold = materialize(evaluation.gold_documents(questions(spark, sf_dir), docs), "gold")
    told = bm25_top(spark, sf_dir, 10).select("qid", F.array(F.col("id").cast("string")).alias("document_ids"))
    return evaluation.packed_recall(told, gold).select("qid", rounded(F.col("packed_context_recall_at_k")).alias("packed_context_recall_at_k"))


@query(
    f"{_BODY}, pool AS (SELECT qid, id, score FROM bm UNION ALL SELECT qid, id, 0.0 FROM q, (SELECT id FROM d ORDER BY id LIMIT 10)), best AS (SELECT qid, id, max(score) AS score FROM pool GROUP BY 1, 2), "
    f"ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM best) WHERE rank <= 10), "
    f"hit AS (SELECT r.qid, bool_or(contains({cf('d.text')}, 'that')) AS h FROM ranked r JOIN d ON d.id = r.id GROUP BY 1) "
    "SELECT qid, TRUE AS answer_evaluable, CASE WHEN h THEN 1.0 ELSE 0.0 END::DOUBLE AS answer_hit FROM hit"
)
def evaluate_answer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one of the ten best documents holds the answer."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    told = bm25_top(spark, sf_dir, 10).select("qid", "id").join(docs, "id").select("qid", "text")
    return evaluation.answer_hits(told, asked(spark, sf_dir).withColumn("answer", F.lit("that")))


_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluation.METRICS[:5])


@query(f"{_EVAL} SELECT question_type, count(*) AS count, {_MEANS} FROM (SELECT *, CASE WHEN qid % 2 = 0 THEN 'even' ELSE 'odd' END AS question_type FROM m) GROUP BY 1")
def evaluate_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("qid") % 2 == 0, "even").otherwise("odd")
    return evaluation.summarize(bm25_metrics(spark, sf_dir).withColumn("question_type", kind), "question_type")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def evaluate_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.percentiles(table(spark, sf_dir, "events"), "value", ["event_type"])


@query(f"WITH {_GOLD}, n AS (SELECT count(DISTINCT qid) AS c FROM gold) SELECT c AS complete_qa, c AS partial_qa, (SELECT count(*) FROM benchmark) AS total_qa FROM n")
def evaluate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("t").alias("title"))
    return evaluation.evidence_coverage(questions(spark, sf_dir), docs)


@query(
    """WITH a AS (SELECT doc_id AS qid, quality::VARCHAR AS question_type, toxic AS evidence_count FROM labels),
b AS (SELECT *, row_number() OVER (PARTITION BY question_type, evidence_count ORDER BY sha1('42:' || qid), qid) AS n, count(*) OVER (PARTITION BY question_type, evidence_count) AS c FROM a),
c AS (SELECT *, round_even(c * 0.7, 0) AS x, round_even(c * 0.7, 0) + round_even(c * 0.15, 0) AS y FROM b)
SELECT qid, question_type, evidence_count, CASE WHEN n <= x THEN 'train' WHEN n <= y THEN 'dev' ELSE 'test' END AS split FROM c"""
)
def evaluate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), F.col("quality").cast("string").alias("question_type"), F.col("toxic").alias("evidence_count"))
    return evaluation.split(rows)


@query(f"SELECT doc_id, contains({cf('text')}, 'that the') AS hit FROM documents")
def evaluate_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.contains_answer(F.col("text"), F.lit("  That   the ")).alias("hit"))


@query()
def evaluate_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = materialize(questions(spark, sf_dir), "qa")
    return experiments.summary(experiments.evaluate(small_index(spark, sf_dir, True), qa, config=Settings(use_dense=False)))


# --- enrichment -------------------------------------------------------------------------------------------


_ENRICHED = f"""{_CAL},
fact AS (SELECT *, source || ' ' || replace(relation, '_', ' ') || ' ' || target AS told FROM cal),
bad AS (
  SELECT unnest(ids[1:2]) AS id FROM (SELECT list(id ORDER BY ord) AS ids FROM cal GROUP BY s, t HAVING count(*) > 2)),
known AS (
  SELECT id, source, target, relation, evidence_type, 'In short: (' || source || ', ' || relation || ', ' || target || ')' AS semantic_summary,
         'What is known of ' || rtrim(told || '.', '.') || '?' AS generated_questions, (length(told) % 10) / 10.0::DOUBLE AS importance,
         CASE WHEN id IN (SELECT id FROM bad) THEN 'contradiction' ELSE conflict_status END AS conflict_status
  FROM fact),
nexts AS (SELECT id AS next_id, s, target, t, row_number() OVER (PARTITION BY s ORDER BY ord, id) AS n FROM cal),
chain AS (
  SELECT a.source, b.target, a.s, b.t, row_number() OVER (ORDER BY a.reliability DESC, a.ord, a.id, b.n) AS k
  FROM cal a JOIN nexts b ON b.s = a.t AND b.n <= 5),
fresh AS (
  SELECT arg_min(source, k) AS source, arg_min(target, k) AS target, s, t FROM chain c
  WHERE k <= 200 AND NOT EXISTS (SELECT 1 FROM cal e WHERE e.s = c.s AND e.t = c.t AND e.relation = 'associated_with') GROUP BY s, t)"""


@query(
    f"WITH {_ENRICHED} SELECT * FROM known UNION ALL SELECT {sid('inferred', 's', 't', chr(39) + 'associated_with' + chr(39))}, source, target, 'associated_with', 'inferred', '', '', 0.6::DOUBLE * 0.8::DOUBLE, 'ok' FROM fresh"
)
def enrich_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = graph_index(spark, sf_dir)
    entities, edges = enrichment.enrich_graph(index.entities, index.edges, enrichment.RuleClient())
    return edges.select("id", "source", "target", "relation", "evidence_type", "semantic_summary", listed("generated_questions"), "importance", "conflict_status")


_RESOLVED = f"""{_ENTITIES},
known AS (SELECT {ekey('title')} AS key, arg_min(title, {{'d': -degree, 'p': pos}}) AS title FROM entities GROUP BY 1),
moved AS (
  SELECT e.*, a.title AS new_source, b.title AS new_target, a.key AS sk, b.key AS tk
  FROM edges0 e JOIN known a ON a.key = {ekey('e.source')} JOIN known b ON b.key = {ekey('e.target')} WHERE a.key <> b.key),
again AS (
  SELECT arg_min(id, ord) AS id, arg_min(new_source, ord) AS source, arg_min(new_target, ord) AS target, relation, sum(weight) AS weight, count(*) AS n,
         arg_min(source_docs, ord) AS own, list_sort(list_distinct(flatten(list(source_docs)))) AS every,
         arg_min(evidence_text, ord) AS evidence_text, arg_min(evidence_type, ord) AS evidence_type, arg_min(llm_conf, ord) AS llm_conf, arg_min(ontology_ok, ord) AS ontology_ok, min(ord) AS ord
  FROM moved GROUP BY sk, tk, relation)"""


@query(f"WITH {_RESOLVED} SELECT id, source, target, relation, weight, array_to_string(CASE WHEN n > 1 THEN every ELSE own END, '|') AS source_docs FROM again")
def enrich_resolve_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = graph_index(spark, sf_dir)
    entities = enrichment.enrich_entities(index.entities, index.edges, enrichment.RuleClient())
    return graph.resolve_aliases(entities, index.edges)[1].select("id", "source", "target", "relation", "weight", listed("source_docs"))


@query(
    f"""WITH {_RESOLVED}, merged2 AS (SELECT {ekey('title')} AS key, arg_min(id, pos) AS id, arg_min(title, pos) AS old, sum(degree)::BIGINT AS degree, list_sort(list_distinct(flatten(list(text_unit_ids)))) AS units FROM entities GROUP BY 1)
SELECT m.id, k.title, m.degree, array_to_string(units, '|') AS text_unit_ids FROM merged2 m JOIN known k USING (key)"""
)
def enrich_resolved_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = graph_index(spark, sf_dir)
    entities = enrichment.enrich_entities(index.entities, index.edges, enrichment.RuleClient())
    return graph.resolve_aliases(entities, index.edges)[0].select("id", "title", "degree", listed("text_unit_ids"))


_FINAL = f"""{_RESOLVED},
final0 AS (SELECT id, source, target, relation, {cf('source')} AS s, {cf('target')} AS t, weight, CASE WHEN n > 1 THEN every ELSE own END AS source_docs, evidence_text, evidence_type, llm_conf, ontology_ok, ord FROM again),
fdeg AS (SELECT title, count(*) AS degree FROM (SELECT unnest([source, target]) AS title FROM final0) GROUP BY 1),
final AS (SELECT e.*, a.degree + b.degree AS combined_degree FROM final0 e JOIN fdeg a ON a.title = e.source JOIN fdeg b ON b.title = e.target),
{_CAL[len(_EDGES) + 1 :].strip().replace('FROM edges)', 'FROM final)')}"""


@query(f"WITH {_FINAL} SELECT id, source, target, relation, combined_degree, evidence_score, structural_score, consistency_score, conflict_status, reliability FROM cal")
def enrich_finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the enriched index: aliases resolved, degrees counted and reliability found anew."""
    full = enrich_index(small_index(spark, sf_dir), enrichment.RuleClient(), ["summaries", "entities"])
    return full.edges.select("id", "source", "target", "relation", "combined_degree", "evidence_score", "structural_score", "consistency_score", "conflict_status", "reliability")


@query(
    f"WITH {_EDGES} SELECT count(*) AS n_edges, count(*) FILTER (evidence_type = 'explicit') AS n_explicit, count(*) FILTER (len(source_docs) > 1) AS n_shared, max(combined_degree) AS top_degree FROM edges"
)
def enrich_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = extraction.with_combined_degree(extraction.merge_edges(extraction.relation_rows(units_of(spark, sf_dir))))
    return edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("evidence_type") == "explicit").alias("n_explicit"), F.count_if(F.size("source_docs") > 1).alias("n_shared"), F.max("combined_degree").alias("top_degree"))


@query("SELECT ts_hour, event_type, n, round(mean_value, 6) AS mean_value FROM (SELECT date_trunc('hour', ts) AS ts_hour, event_type, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY 1, 2)")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.extract import windowed_events

    found = windowed_events(table(spark, sf_dir, "events"))
    return found.select(F.col("window.start").alias("ts_hour"), "event_type", "n", rounded(F.col("mean_value")).alias("mean_value"))


#: Pieces of SQL for those who report on the same rankings and edges: the scores ``bm`` (qid, id, score) after WITH, evidence, calibrated edges.
BODY_SQL, GOLD_SQL, CALIBRATED_SQL = _BODY, _GOLD, _CAL
