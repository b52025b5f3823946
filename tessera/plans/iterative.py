"""Iterative retrieval: bridge entities of the first documents give follow-up queries, whose rankings are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as r
from ..functions import text as t
from ..operators import scoring
from ..operators.scoring import DIGITS
from ..storage import materialize
from . import models
from .config import Settings
from .context import reliability_factor
from .index import Index
from .ranking import body_text, document_edges, field_tokens, rank_documents


def bridge_entities(index: Index, queries: DataFrame, ranked: DataFrame, config: Settings) -> DataFrame:
    """(qid, entity, score, n): entities of the seed documents' edges, the best first.

    ``ranked``: (qid, id, rank, score).  Documents whose one-word title is in the query are passed over, and so are
    entities in the query or of more than six tokens.
    """
    asked = queries.select("qid", F.col("text").alias("_q"), t.content_tokens(F.col("text")).alias("_qt"))
    seeds = ranked.where(F.col("rank") <= config.iterative_seed_k).select("qid", "id", "rank", F.col("score").alias("_s")).join(asked, "qid")
    title = F.array_distinct(t.content_tokens(F.col("title")))
    docs = index.documents.select("id", title.alias("_title"))
    kept = seeds.join(docs, "id").where(~((F.size("_title") == 1) & t.subset(F.col("_title"), F.col("_qt"))))
    edges = document_edges(index).select("id", "ord", "edge_id", "source", "target", "reliability", t.content_tokens(F.coalesce(F.nullif("edge_text", F.lit("")), "description")).alias("_text"))
    match = t.lexical_of(F.col("_qt"), F.col("_text"))
    base = F.col("_s") * reliability_factor(F.col("reliability")) * (0.25 + match)
    ends = kept.join(edges, "id").withColumn("_base", base).select("qid", "rank", "ord", "edge_id", "_qt", "_base", F.posexplode(F.array("source", "target")).alias("end", "title"))
    ends = ends.withColumns({"key": t.casefold(F.col("title")), "_tt": t.content_tokens(F.col("title"))})
    ends = ends.where((F.size("_tt") > 0) & (F.size("_tt") <= 6) & ~t.subset(t.content_tokens(F.col("key")), F.col("_qt")))
    kind = F.array_join(F.array_compact(F.array(*[F.nullif(t.nvl(c), F.lit("")) for c in ("type", "category", "description")])), " ")
    last = index.entities.groupBy(t.casefold(F.col("title")).alias("key")).agg(F.max_by(t.casefold(kind), "ord").alias("_kind"))
    factor = r.bridge_factor(F.col("_qt"), t.nvl("_kind"), F.size("_tt"))
    scored = ends.join(last, "key", "left").withColumn("score", F.round(F.col("_base") * factor, DIGITS))
    merged = scored.groupBy("qid", "key").agg(F.min_by("title", F.struct("rank", "ord", "edge_id", "end")).alias("entity"), F.max("score").alias("score"))
    return merged.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "key")))


def bridge_queries(queries: DataFrame, entities: DataFrame, most: int = 8) -> DataFrame:
    """(qid, n, entity, text): the entity and the query's first hint (or the query), distinct, at most ``most``."""
    hint = queries.select("qid", F.coalesce(F.try_element_at(r.relation_hints(F.col("text")), F.lit(1)), "text").alias("_h"))
    text = t.strip(F.concat("entity", F.lit(" "), "_h"))
    told = entities.join(hint, "qid").select("qid", "n", "entity", text.alias("text")).where("text <> ''")
    first = told.withColumn("_d", F.row_number().over(Window.partitionBy("qid", "text").orderBy("n"))).where("_d = 1")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("n"))).where(F.col("n") <= most).select("qid", "n", "entity", "text")


def mentions(index: Index, wanted: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The (.., id, entity) rows of ``wanted`` whose document has all content tokens of the entity, or an edge with it; ``texts``: see ``rank_documents``."""
    bodies = body_text(index).select("id", t.content_tokens(F.col("text")).alias("tokens")) if texts is None else texts.where("field = 'body'")
    tokens = bodies.join(wanted.select("id").distinct(), "id", "left_semi").select("id", F.col("tokens").alias("_b"))
    in_text = wanted.join(tokens, "id").where(t.subset(t.content_tokens(F.col("entity")), F.col("_b"))).select(*wanted.columns)
    ends = document_edges(index).select("id", F.explode(F.array("source", "target")).alias("_e")).select("id", t.casefold(F.col("_e")).alias("_k")).distinct()
    some = F.size(t.content_tokens(F.col("entity"))) > 0
    in_edges = wanted.where(some).withColumn("_k", t.casefold(F.col("entity"))).join(ends, ["id", "_k"], "left_semi").select(*wanted.columns)
    return in_text.unionByName(in_edges).distinct()


def merge_rankings(lists: DataFrame, top_k: int, config: Settings) -> DataFrame:
    """(qid, id, rank, score, best): fuses rankings (qid, list, weight, id, rank, score); list 0 is the first query's own.

    ``best`` is the list in which the document scored best.  The first document of list 0 stays: if it is not
    among the ``top_k``, it takes the last place.
    """
    kept = lists.where(F.col("rank") <= config.candidate_k)
    fused = kept.groupBy("qid", "id").agg(
        F.sum(F.col("weight") / (config.rrf_k + F.col("rank"))).alias("raw"), F.min_by("list", F.struct(-F.col("score"), "list")).alias("best"),
        F.max((F.col("list") == 0) & (F.col("rank") == 1)).alias("seed"),
    )
    fused = fused.withColumn("score", F.round(F.col("raw") / F.max("raw").over(Window.partitionBy("qid")), 6))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    ranked = fused.withColumn("rank", F.row_number().over(order))
    late = F.max(F.col("seed") & (F.col("rank") > top_k)).over(Window.partitionBy("qid"))
    full = ranked.withColumn("late", late).where((F.col("rank") < top_k) | ((F.col("rank") == top_k) & ~F.col("late")) | (F.col("seed") & F.col("late") & (F.col("rank") > top_k)))
    return full.select("qid", "id", F.least("rank", F.lit(top_k)).alias("rank"), "score", "best")


def retrieve_iterative(index: Index, queries: DataFrame, config: Settings | None = None, calibrated: bool = True, top_k: int | None = None, embedder: scoring.Embedder | None = None, reranker: models.Reranker | None = None) -> DataFrame:
    """(qid, id, rank, score, title, snippet): ``rank_documents`` of the queries and of their bridge queries, merged.

    All bridge queries of all queries are ranked in one plan.  The tokens of the documents are made once, for both rankings and the mentions.
    """
    config = config or Settings()
    top = top_k or config.top_k
    index = index.visible(calibrated, config.uses("use_inferred_edges"))
    own = ["qid", "id", "rank", "score", "title", "snippet"]
    texts = materialize(field_tokens(index, config), "fields")
    first = materialize(rank_documents(index, queries, config, calibrated, max(top, config.iterative_seed_k), embedder, reranker, texts).select(*own), "first")
    bridges = materialize(bridge_queries(queries, bridge_entities(index, queries, first, config), config.iterative_bridge_k), "bridges")
    asked = bridges.select(F.concat_ws("#", F.col("qid").cast("string"), "n").alias("qid"), F.col("qid").alias("_qid"), "n", "entity", "text")
    more = materialize(rank_documents(index, asked.select("qid", "text"), config, calibrated, max(top, config.candidate_k), embedder, reranker, texts).select(*own), "more")
    more = more.join(asked.select("qid", "_qid", "n", "entity"), "qid").drop("qid").withColumnRenamed("_qid", "qid")
    heard = mentions(index, more, texts)
    ranked = heard.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "n").orderBy("rank")))
    lists = first.select("qid", F.lit(0).alias("list"), F.lit(1.0).alias("weight"), *own[1:]).unionByName(
        ranked.select("qid", F.col("n").alias("list"), F.lit(config.iterative_bridge_weight).alias("weight"), *own[1:])
    )
    merged = merge_rankings(lists, top, config)
    told = lists.select("qid", F.col("list").alias("best"), "id", "title", "snippet")
    return merged.join(told, ["qid", "best", "id"]).select(*own)
