"""Two-stage document ranking of a whole table of queries.

Stage one: BM25 over several fields and a dense list, fused by reciprocal ranks; stage two: rerank, then
an order that prefers documents which cover clauses that are still open.  Every list ranks all
documents by (-score, id), so documents without a match still collect credit in a list that is not
full; instead of ranking all, each list takes its matches and the first ``candidate_k`` documents by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import rules as r
from ..functions import text as t
from ..operators import scoring
from ..operators.scoring import DIGITS, TEXTS_AT_ONCE, Nearest, counted_terms
from ..storage import materialize
from . import models
from .config import Settings
from .index import Index

# Weight of each field list in the fusion.
FIELD_WEIGHTS = {
    "title": 1.25, "body": 1.0, "metadata": 0.80, "graph": 0.20, "questions": 0.35, "summaries": 0.20, "entities": 0.10, "inferred_edges": 0.18, "dense": 0.75,
}
ENRICHED = ("questions", "summaries", "entities", "inferred_edges")
SNIPPET_TOKENS = 180


def document_edges(index: Index) -> DataFrame:
    """(id, edge columns): the edges of each document."""
    return index.edges.withColumn("_doc", F.explode("source_docs")).withColumnRenamed("id", "edge_id").withColumnRenamed("_doc", "id")


def metadata_text(d: str = "") -> Column:
    parts = [F.nullif(t.nvl(f"{d}{c}"), F.lit("")) for c in ("title", "source", "category", "published_at", "author")]
    return F.array_join(F.array_compact(F.array(*parts)), " ")


def body_text(index: Index) -> DataFrame:
    """(id, text): the title and all units of a document, or its text if it has no unit.

    The ids of the few documents without a unit are found first, so that no other document's text is shuffled beside its units.
    """
    units, docs = index.units.select(F.col("document_id").alias("id"), "position", "text"), index.documents
    bare = materialize(docs.where("id is not null").select("id").join(units.select("id"), "id", "left_anti"), "bare")
    units = units.unionByName(docs.join(bare, "id", "left_semi").select("id", F.lit(0).alias("position"), "text"))
    units = units.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda u: u["text"]), " ").alias("_u"))
    told = docs.select("id", "title", F.when(F.col("id").isNull(), F.col("text")).alias("text")).join(units, "id", "left")
    return told.select("id", F.concat(t.nvl("title"), F.lit(". "), F.coalesce("_u", "text", F.lit(""))).alias("text"))


def entity_text() -> Column:
    parts = F.array(*[F.nullif(t.nvl(c), F.lit("")) for c in ("enriched_description",)], F.nullif(F.array_join("aliases", " "), F.lit("")), F.nullif(t.nvl("category"), F.lit("")))
    return F.array_join(F.array_compact(parts), " ")


def joined(column: Column) -> Column:
    """Texts of a group in the order of their edges, joined by spaces."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("edge_id", column.alias("x")))), lambda s: s["x"]), " ")


def field_texts(index: Index, config: Settings) -> DataFrame:
    """(field, id, text) of every field list that is on, for all documents; enriched fields only where they have text."""
    docs = index.documents
    out = docs.select(F.lit("title").alias("field"), "id", t.nvl("title").alias("text"))
    out = out.unionByName(body_text(index).select(F.lit("body").alias("field"), "id", "text"))
    out = out.unionByName(docs.select(F.lit("metadata").alias("field"), "id", metadata_text().alias("text")))
    wanted: dict[str, Column] = {}
    questions = F.array_join("generated_questions", " ")
    summary = F.nullif(F.col("semantic_summary"), F.lit(""))
    if config.use_graph:
        parts = [F.col("edge_text")]
        parts += [F.array_join(F.slice("generated_questions", 1, 2), " ")] * config.uses("use_generated_questions")
        parts += [summary] * config.uses("use_semantic_summaries")
        wanted["graph"] = F.concat_ws(" ", *parts)
    if config.uses("use_generated_questions"):
        wanted["questions"] = questions
    if config.uses("use_semantic_summaries"):
        wanted["summaries"] = t.nvl(summary)
    if config.uses("use_inferred_edges"):
        told = F.concat_ws(" ", F.col("edge_text"), *[summary] * config.uses("use_semantic_summaries"))
        wanted["inferred_edges"] = F.when(F.col("evidence_type") == "inferred", told).otherwise("")
    if wanted:
        by_doc = document_edges(index).groupBy("id").agg(*[joined(c).alias(n) for n, c in wanted.items()])
        full = docs.select("id").join(by_doc, "id", "left")
        stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), t.nvl(n).alias("text")) for n in wanted]))
        out = out.unionByName(full.select("id", stacked.alias("s")).select("s.field", "id", "s.text"))
    if config.uses("use_entity_enrichment"):
        ends = document_edges(index).select("id", F.explode(F.array("source", "target")).alias("e")).select("id", t.casefold(F.col("e")).alias("key")).distinct()
        last = index.entities.groupBy(t.casefold(F.col("title")).alias("key")).agg(F.max_by(entity_text(), "ord").alias("text"))
        told = ends.join(last, "key").groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))
        out = out.unionByName(docs.select("id").join(told, "id", "left").select(F.lit("entities").alias("field"), "id", t.nvl("text").alias("text")))
    return out


def document_features(index: Index, config: Settings, calibrated: bool) -> DataFrame:
    """(id, reliability, importance, contradiction_penalty) of every document; 0 without edges or where the signal is off."""
    by_doc = document_edges(index).groupBy("id").agg(
        F.avg(F.when(F.col("evidence_type") != "inferred", F.col("reliability"))).alias("reliability"),
        F.avg("importance").alias("importance"),
        (-F.avg((F.col("conflict_status") == "contradiction").cast("double"))).alias("contradiction_penalty"),
    )
    on = {"reliability": calibrated, "importance": config.uses("use_edge_importance"), "contradiction_penalty": config.uses("use_contradiction_penalty")}
    joined_ = index.documents.select("id").join(by_doc, "id", "left")
    return joined_.select("id", *[(F.round(F.coalesce(c, F.lit(0.0)), DIGITS) if use else F.lit(0.0)).alias(c) for c, use in on.items()])


def subqueries(queries: DataFrame, config: Settings) -> DataFrame:
    """(qid, sub, text): the clauses of each query (qid, text), the whole first."""
    return queries.select("qid", F.posexplode(r.decompose(F.col("text"), config.max_subqueries)).alias("sub", "text"))


def field_tokens(index: Index, config: Settings) -> DataFrame:
    """(field, id, tokens) of every field list that is on, for all documents."""
    return field_texts(index, config).select("field", "id", t.content_tokens(F.col("text")).alias("tokens"))


def ranked_lists(index: Index, queries: DataFrame, config: Settings, embedder: scoring.Embedder | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(qid, sub, field, id, score, rank): the first ``candidate_k`` of every list of every clause; ``texts``: the ``field_tokens``, if they are written already."""
    subs = materialize(subqueries(queries, config), "clauses")
    if texts is None:
        texts = field_tokens(index, config)
        if config.use_dense or config.use_enrichment:  # branches beside BM25 read the tokens too
            texts = materialize(texts, "fields")
    some = texts.where(F.col("field").isin(*ENRICHED) & (F.size("tokens") > 0)).select("field").distinct() if config.use_enrichment else None
    always = [f for f in ("title", "body", "metadata", "graph") if f != "graph" or config.use_graph]
    fields = subs.sparkSession.createDataFrame([(f,) for f in always], "field string")
    fields = fields if some is None else fields.unionByName(some)
    scored = scoring.bm25_top_k(texts, subs, ["qid", "sub"], config.candidate_k, "field")
    scored = scored.join(F.broadcast(fields), "field")  # at most eight names
    head = index.documents.select("id").orderBy("id").limit(config.candidate_k)
    lists = subs.select("qid", "sub").crossJoin(F.broadcast(fields.unionByName(subs.sparkSession.createDataFrame([("dense",)], "field string"))))
    zeros = lists.crossJoin(F.broadcast(head)).withColumn("score", F.lit(0.0))  # ``candidate_k`` rows
    # the first of a union are among the first of its parts; only these are here
    order = Window.partitionBy("qid", "sub", "field").orderBy(F.desc("score"), "id")
    first = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.candidate_k)
    every = scored.select("qid", "sub", "field", "id", "score").unionByName(zeros.select("qid", "sub", "field", "id", "score"))
    if config.use_dense:
        embedder = embedder or models.embedder(config)
        bodies = texts.where("field = 'body'").select("id", "tokens")
        if embedder is not scoring.hashed_embedder:  # a model reads the text itself
            bodies = bodies.join(body_text(index), "id")
        dense = scoring.dense_top_k(subs, bodies, ["qid", "sub"], config.candidate_k, embedder)
        every = every.unionByName(dense.select("qid", "sub", F.lit("dense").alias("field"), "id", "score"))
    return first(every.groupBy("qid", "sub", "field", "id").agg(F.max("score").alias("score")))


def metadata_tokens() -> Column:
    return F.array_distinct(t.content_tokens(metadata_text()))


def metadata_match(index: Index, queries: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(qid, id, metadata_match): share of the document's metadata tokens that are in the query, where above 0; only for ``pairs``, if they are given."""
    own = index.documents.select("id", metadata_tokens().alias("m"))
    asked = queries.select("qid", F.array_distinct(t.content_tokens(F.col("text"))).alias("q"))
    if pairs is not None:
        both = pairs.select("qid", "id").distinct().join(own, "id").join(asked, "qid").withColumn("hit", F.size(F.array_intersect("m", "q"))).where("hit > 0")
        return both.select("qid", "id", F.round(F.col("hit") / F.size("m"), DIGITS).alias("metadata_match"))
    docs = own.select("id", F.size("m").alias("n"), F.explode("m").alias("term"))
    met = docs.join(asked.select("qid", F.explode("q").alias("term")), "term").groupBy("qid", "id", "n").agg(F.count("*").alias("hit"))
    return met.select("qid", "id", F.round(F.col("hit") / F.col("n"), DIGITS).alias("metadata_match"))


STATIC = ("reliability", "importance", "contradiction_penalty")


def best_by_metadata(index: Index, queries: DataFrame, features: DataFrame, config: Settings) -> DataFrame:
    """(qid, id): of the documents that share a metadata token with the query the ``candidate_k`` best by that and the features that don't depend on the query.

    A token that many documents and queries have makes no rows of pairs: a partition scores its documents for all queries of a pass
    and hands on its best.
    """
    docs = index.documents.select("id", metadata_tokens().alias("m")).join(features.select("id", *STATIC), "id")
    passes = max(1, -(-queries.count() // scoring.QUERIES_PER_PASS))
    schema = StructType([*queries.select("qid").schema.fields, index.documents.schema["id"], StructField("s", DoubleType())])
    arrow, k, weights = to_arrow_schema(schema), config.candidate_k, dict(config.weights)
    out = None
    for p in range(passes):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p)
        asked = part.select("qid", F.array_distinct(t.content_tokens(F.col("text"))).alias("q")).collect()  # QUERIES_PER_PASS queries
        vocabulary = sorted({x for r in asked for x in r["q"]})
        number = {x: i for i, x in enumerate(vocabulary)}
        entry = np.array([(number[x], i) for i, r in enumerate(asked) for x in r["q"]], np.int64).reshape(-1, 2)
        entry = entry[np.argsort(entry[:, 0], kind="stable")]
        model = queries.sparkSession.sparkContext.broadcast((vocabulary, [r["qid"] for r in asked], entry))

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            vocabulary, qids, entry = model.value
            terms, best = pa.array(vocabulary, pa.string()), Nearest(len(qids), k)
            first = np.searchsorted(entry[:, 0], np.arange(len(vocabulary) + 1))
            for whole in batches:
                for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                    batch = whole.slice(at, TEXTS_AT_ONCE)
                    text, term, _, size = counted_terms(batch.column(1), terms)
                    if not len(text):
                        continue
                    n = first[term + 1] - first[term]
                    place = np.repeat(first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    hits = np.bincount(entry[place, 1] * batch.num_rows + np.repeat(text, n), minlength=len(qids) * batch.num_rows).reshape(len(qids), -1)
                    sizes = np.ones(batch.num_rows)
                    sizes[text] = size
                    told = {"metadata": np.round(hits / sizes, DIGITS)} | {c: np.asarray(batch.column(2 + i).to_numpy(zero_copy_only=False), float)[None, :] for i, c in enumerate(STATIC)}
                    score = np.zeros(hits.shape)
                    for name, w in weights.items():  # in the order of the weights, as everywhere
                        if name in told:
                            score = score + w * told[name]
                    score = np.floor(score * 10.0**DIGITS + 0.5) / 10.0**DIGITS
                    best.add(batch.column(0).to_pylist(), np.where(hits > 0, score, -np.inf))
            rows = [(qids[q], i, s) for q, i, s in best.rows() if s > -np.inf]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("qid").orderBy(F.desc("s"), "id")
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("qid", "id")


def weighted(weights: dict[str, float], without: tuple[str, ...] = ()) -> Column:
    """Sum of weight times feature, in the order of the weights."""
    out = F.lit(0.0)
    for name, w in weights.items():
        if name not in without:
            out = out + F.lit(w) * F.col(name)
    return out


def snapped(value: Column, digits: int = DIGITS) -> Column:
    """``value`` to so many digits.  Weighted sums of rounded features often end in an exact half, which this form, unlike
    ``round``, decides by the same operations in every engine."""
    return F.floor(value * 10.0**digits + 0.5) / 10.0**digits


FEATURES = ("rrf", "bm25", "dense", "metadata", "graph", "enrichment")


def first_stage(index: Index, queries: DataFrame, config: Settings, calibrated: bool = True, embedder: scoring.Embedder | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(qid, id, features, clause_scores, first_score, rank): the ``candidate_k`` best documents of each query before reranking.

    Candidates are the documents in a list, of those that share a metadata token the ``candidate_k`` best by that and by the
    features that don't depend on the query, and the ``candidate_k`` best by the latter alone.  No other document can be
    among the first: so many others score at least as much.
    """
    lists = materialize(ranked_lists(index, queries, config, embedder, texts), "lists")
    weight = F.lit(0.0)
    for name, w in FIELD_WEIGHTS.items():
        weight = F.when(F.col("field") == name, F.lit(w)).otherwise(weight)
    best = lambda *names: F.max(F.when(F.col("field").isin(*names), F.col("score")))
    clause = lists.groupBy("qid", "sub", "id").agg(
        F.sum(weight / (config.rrf_k + F.col("rank"))).alias("rrf"), best("title", "body").alias("bm25"), best("dense").alias("dense"),
        best("metadata").alias("metadata"), best("graph").alias("graph"), best(*ENRICHED).alias("enrichment"), F.max("score").alias("clause"),
    )
    fused = clause.groupBy("qid", "id").agg(
        F.sum("rrf").alias("rrf"), *[F.max(c).alias(c) for c in FEATURES[1:]],
        F.count_if(F.col("clause") >= 0.2).alias("covered"), F.collect_list(F.struct("sub", "clause")).alias("clauses"),
    )
    fused = fused.withColumn("rrf", F.round(F.col("rrf") / F.max("rrf").over(Window.partitionBy("qid")), DIGITS))
    doc = materialize(document_features(index, config, calibrated), "features")
    static = weighted(config.weights, tuple(k for k in config.weights if k not in STATIC))
    head = doc.orderBy(F.desc(static), "id").limit(config.candidate_k).select("id")
    near = materialize(best_by_metadata(index, queries, doc, config), "near")
    asked = queries.select("qid", F.size(r.decompose(F.col("text"), config.max_subqueries)).alias("n_sub")).where("n_sub > 0")
    pool = fused.select("qid", "id").unionByName(near).unionByName(asked.select("qid").crossJoin(F.broadcast(head))).distinct()  # ``candidate_k`` rows

    def described(pool: DataFrame) -> DataFrame:
        match = metadata_match(index, queries, pool)
        full = pool.join(asked, "qid").join(fused, ["qid", "id"], "left").join(match, ["qid", "id"], "left").join(doc, "id")
        full = full.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in (*FEATURES, "metadata_match")})
        by_sub = F.map_from_entries(F.coalesce("clauses", F.array().cast("array<struct<sub:int,clause:double>>")))
        return full.withColumns(
            {
                "metadata": F.greatest("metadata", "metadata_match"),
                "coverage": F.coalesce("covered", F.lit(0)) / F.col("n_sub"),
                "clause_scores": F.transform(F.sequence(F.lit(0), F.col("n_sub") - 1), lambda i: F.coalesce(F.try_element_at(by_sub, i), F.lit(0.0))),
                "reranker": F.lit(0.0),
                "graph_expansion": F.lit(0.0),
            }
        )

    full = described(pool)
    if config.use_graph_expansion:  # documents that only the graph leads to are candidates too
        found = materialize(graph_expansion(index, queries, full, config), "expansion")
        full = described(pool.unionByName(found.select("qid", "id")).distinct()).drop("graph_expansion")
        full = full.join(found, ["qid", "id"], "left").withColumn("graph_expansion", F.coalesce("graph_expansion", F.lit(0.0)))
    full = full.withColumn("first_score", snapped(weighted(config.weights, ("reranker",))))
    order = Window.partitionBy("qid").orderBy(F.desc("first_score"), "id")
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.candidate_k).drop("clauses", "covered", "metadata_match", "n_sub")


def document_entities(index: Index) -> DataFrame:
    """(id, entity): casefolded names in the edges of a document, those with a content token."""
    ends = document_edges(index).select("id", F.explode(F.array("source", "target")).alias("e")).where(F.size(t.content_tokens(F.col("e"))) > 0)
    return ends.select("id", t.casefold(F.col("e")).alias("entity")).distinct()


def graph_expansion(index: Index, queries: DataFrame, features: DataFrame, config: Settings) -> DataFrame:
    """(qid, id, graph_expansion): documents that share entities, not named in the query, with the best seed documents."""
    score = snapped(weighted(config.weights, ("reranker", "graph_expansion")))
    order = Window.partitionBy("qid").orderBy(F.desc("s"), "id")
    seeds = features.select("qid", "id", score.alias("s")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(1, config.graph_expansion_seed_k))
    named = document_entities(index)
    asked = queries.select("qid", t.content_tokens(F.col("text")).alias("q"))
    bridge = seeds.join(named, "id").join(asked, "qid").where(~t.subset(t.content_tokens(F.col("entity")), F.col("q"))).groupBy("qid", "entity").agg(F.max("s").alias("w"))
    raw = materialize(bridge.join(named, "entity").groupBy("qid", "id").agg(F.sum("w").alias("raw")), "bridges")
    best = raw.groupBy("qid").agg(F.max("raw").alias("best"))
    return raw.join(best, "qid").where("best > 0").select("qid", "id", F.round(F.col("raw") / F.col("best"), DIGITS).alias("graph_expansion"))


def best_snippets(index: Index, queries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, id, snippet) for the pairs ``wanted``: the unit of the document that suits the query best, its own units being the corpus."""
    ids = wanted.select("id").distinct()
    units = index.units.withColumnRenamed("id", "unit_id").withColumnRenamed("document_id", "id").join(ids, "id", "left_semi")
    # the few units of what is wanted are written with their tokens: both branches below would make those of all units, several times
    units = materialize(units.select("id", "position", "text", t.content_tokens(F.col("text")).alias("tokens")), "units")
    # the one unit of a document is its best (the first is the default below); of documents with more the units are weighed where they meet
    several = units.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("position", "tokens"))).alias("units")).where("size(units) > 1 or units[0].position <> 0")
    best = scoring.best_parts(several.join(wanted.groupBy("id").agg(F.collect_set("qid").alias("qids")), "id"), queries)
    chosen = wanted.select("qid", "id").join(best, ["qid", "id"], "left").withColumn("position", F.coalesce("position", F.lit(0)))
    text = units.select("id", "position", F.col("text").alias("_unit"))
    docs = index.documents.select("id", "title", F.col("text").alias("_doc"))
    full = chosen.join(text, ["id", "position"], "left").join(docs, "id")
    return full.select("qid", "id", "title", t.truncate_to_tokens(F.coalesce("_unit", "_doc"), SNIPPET_TOKENS).alias("snippet"))


def coverage_order(score: np.ndarray, ids: np.ndarray, clauses: np.ndarray, top_k: int, bonus: float = 0.08) -> list[int]:
    """Rows in order: the best score first, then always the row whose score and new coverage are largest; ties to the largest id.

    ``clauses``: how well each row covers each clause of the query.
    """
    by_id = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    free, covered, out = np.ones(len(score), bool), None, []
    while len(out) < top_k and free.any():
        gain = np.zeros(len(score)) if covered is None else np.maximum(0.0, clauses - covered).sum(axis=1)
        worth = np.where(free, score if covered is None else np.floor((score + bonus * gain) * 10.0**DIGITS + 0.5) / 10.0**DIGITS, -np.inf)
        best = int(max(np.flatnonzero(worth == worth.max()), key=by_id.__getitem__))
        out.append(best)
        free[best] = False
        covered = clauses[best] if covered is None else np.maximum(covered, clauses[best])
    return out


def reranked(rows: DataFrame, k: int, model: models.Reranker | None) -> DataFrame:
    """``rows`` (qid, rank, _q, _d, ..) with ``reranker``: similarity of query _q and document _d for the first ``k`` of a query, else 0.

    A model's scores are stretched to the range 0 to 1 per query (all alike: 0.5); without a model it is the cosine of
    content tokens.
    """
    if model is None:
        full = rows.withColumns({"_a": t.content_tokens(F.col("_q")), "_b": t.content_tokens(F.col("_d"))})
        lexical = F.round(t.lexical_of(F.col("_a"), F.col("_b")), DIGITS)
        return full.withColumn("reranker", F.when(F.col("rank") <= k, lexical).otherwise(0.0)).drop("_a", "_b", "_q", "_d")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["qid", "id"]].assign(_v=np.asarray(model(list(pdf["_q"]), list(pdf["_d"])), float) if len(pdf) else [])

    schema = rows.select("qid", "id").schema.add("_v", "double")
    raw = materialize(rows.where(F.col("rank") <= k).select("qid", "id", "_q", "_d").mapInPandas(run, schema), "reranked")
    ends = raw.groupBy("qid").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    spread = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    scaled = raw.join(ends, "qid").select("qid", "id", F.round(spread, DIGITS).alias("_s"))
    return rows.drop("reranker").join(scaled, ["qid", "id"], "left").withColumn("reranker", F.coalesce("_s", F.lit(0.0))).drop("_s", "_q", "_d")


def rank_documents(
    index: Index, queries: DataFrame, config: Settings | None = None, calibrated: bool = True, top_k: int | None = None,
    embedder: scoring.Embedder | None = None, reranker: models.Reranker | None = None, texts: DataFrame | None = None,
) -> DataFrame:
    """(qid, id, rank, score, title, snippet, features): the ranked documents of each query (qid, text).

    ``texts``: the ``field_tokens`` of the visible index, for those who rank more than once.

    ``embedder`` and ``reranker`` are by default those that ``config`` names, where they are there (see ``models``).
    Queries of white space alone have none.  The greedy order runs per query over at most ``candidate_k`` rows.
    """
    config = config or Settings()
    index = index.visible(calibrated, config.uses("use_inferred_edges"))
    first = materialize(first_stage(index, queries, config, calibrated, embedder, texts), "first")
    snippets = best_snippets(index, queries, first)
    full = first.join(snippets, ["qid", "id"]).join(queries.select("qid", F.col("text").alias("_q")), "qid")
    full = reranked(full.withColumn("_d", F.concat("title", F.lit(". "), "snippet")), config.rerank_k, reranker or models.reranker(config))
    full = full.withColumn("score", snapped(weighted(config.weights), 6)).drop("rank", "first_score")
    limit = top_k or config.top_k
    names = [c for c in full.columns if c not in ("qid", "id")]

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = pdf.iloc[coverage_order(pdf["score"].to_numpy(float), pdf["id"].to_numpy(), np.stack(pdf["clause_scores"].to_list()), limit)].copy()
        chosen["rank"] = range(1, len(chosen) + 1)
        return chosen[["qid", "id", "rank", *names]]

    kinds = {f.name: f.dataType.simpleString() for f in full.schema}
    ddl = ", ".join([f"qid {kinds['qid']}", f"id {kinds['id']}", "rank int", *[f"{n} {kinds[n]}" for n in names]])
    return full.select("qid", "id", *names).groupBy("qid").applyInPandas(order, ddl)


def abstains(ranked: DataFrame, queries: DataFrame, config: Settings) -> DataFrame:
    """(qid, abstained): no documents, or the first of them below the threshold."""
    top = ranked.where("rank = 1").select("qid", "score")
    return queries.select("qid").join(top, "qid", "left").select("qid", (F.coalesce("score", F.lit(0.0)) < config.abstention_threshold).alias("abstained"))
