"""Rule extraction: text units to relation rows, edges and entities.

"First" always means first by the ordinal (document, unit position, supplied rows before sentences,
index in the unit), which travels with the rows; no aggregate depends on the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as r
from ..functions import text as t

SUPPLIED = "array<struct<source:string,target:string,relation:string,description:string>>"


def relation_rows(units: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(ord, unit_id, document_id, source, target, relation, ontology_ok, evidence, evidence_type, llm_conf).

    A sentence with two names or more gives a row between the first two.  ``documents`` (id, relationships of
    type SUPPLIED), if given, add their rows to every unit of theirs, before its sentences.  Rows between
    equal names are dropped.
    """
    found = units.select("id", "document_id", "position", F.posexplode(t.sentences(F.col("text"))).alias("k", "evidence"))
    found = found.withColumn("names", t.names(F.col("evidence"))).where("size(names) >= 2").withColumn("rel", r.relation_of(F.col("evidence")))
    parsed = found.select(
        _ordinal(1), "id", "document_id", F.col("names")[0].alias("source"), F.col("names")[1].alias("target"), F.col("rel.name").alias("raw"),
        "evidence", F.lit(False).alias("supplied"),
    )
    if documents is not None:
        given = units.select("id", "document_id", "position", F.col("text").alias("_text")).join(
            documents.select(F.col("id").alias("document_id"), F.posexplode("relationships").alias("k", "r")), "document_id"
        )
        has = documents.select(F.col("id").alias("document_id"), (F.size("relationships") > 0).alias("has"))
        supplied = given.select(
            _ordinal(0), "id", "document_id", F.col("r.source").alias("source"), F.col("r.target").alias("target"),
            t.nvl("r.relation", "related_to").alias("raw"),
            F.coalesce(F.nullif(F.col("r.description"), F.lit("")), "_text").alias("evidence"), F.lit(True).alias("supplied"),
        )
        parsed = parsed.join(has, "document_id", "left").withColumn("supplied", F.coalesce("has", F.lit(False))).select(*supplied.columns).unionByName(supplied)
    norm = r.normalize_relation(F.col("raw"))
    kind = F.when(F.col("raw") == "co_occurs", r.relation_of(F.col("evidence"))["kind"]).otherwise("explicit")
    return (
        parsed.where("source <> target")
        .withColumn("norm", norm)
        .withColumn("evidence_type", kind)
        .select(
            "ord", F.col("id").alias("unit_id"), "document_id", "source", "target", F.col("norm.relation").alias("relation"),
            F.col("norm.ontology_ok").alias("ontology_ok"), "evidence", "evidence_type",
            F.when(F.col("supplied"), 0.85).when(F.col("evidence_type") == "explicit", 0.75).otherwise(0.45).alias("llm_conf"),
        )
    )


def _ordinal(group: int) -> Column:
    return F.struct(F.col("document_id"), F.col("position"), F.lit(group).alias("group"), F.col("k")).alias("ord")


def in_order(ids: Column) -> Column:
    """Distinct values of structs (ord, value) in the order of their first appearance."""
    return F.array_distinct(F.transform(F.sort_array(F.collect_list(ids)), lambda x: x["value"]))


def merge_edges(rows: DataFrame) -> DataFrame:
    """One edge per casefolded (source, target) and relation: the first row's values, all units and documents, weight = rows."""
    first = F.min_by(F.struct("source", "target", "evidence", "evidence_type", "llm_conf", "ontology_ok", "ord"), "ord")
    grouped = rows.groupBy(t.casefold(F.col("source")).alias("source_key"), t.casefold(F.col("target")).alias("target_key"), "relation").agg(
        first.alias("f"),
        F.count("*").cast("double").alias("weight"),
        in_order(F.struct("ord", F.col("unit_id").alias("value"))).alias("text_unit_ids"),
        in_order(F.struct("ord", F.col("document_id").alias("value"))).alias("source_docs"),
    )
    return described_edges(grouped)


def described_edges(grouped: DataFrame) -> DataFrame:
    """Edges from groups (source_key, target_key, relation, f: the first row's values, weight, text_unit_ids, source_docs)."""
    return grouped.select(
        t.stable_id("edge", F.col("source_key"), F.col("target_key"), F.col("relation")).alias("id"),
        "f.source", "f.target", "relation", F.col("f.evidence").alias("description"), "weight", "text_unit_ids",
        F.col("f.evidence").alias("evidence_text"), "f.evidence_type", "source_docs", "f.ontology_ok", "f.llm_conf",
        F.concat("f.source", F.lit(" "), F.replace("relation", F.lit("_"), F.lit(" ")), F.lit(" "), "f.target", F.lit(". "), "f.evidence").alias("edge_text"),
        r.useful_for(F.col("relation")).alias("useful_for"),
        F.lit("ok").alias("conflict_status"), F.col("f.ord").alias("ord"),
        F.array().cast("array<string>").alias("generated_questions"), F.lit("").alias("semantic_summary"),
        F.lit("").alias("contradiction_info"), F.lit(0.5).alias("importance"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """(title, degree): how many edge ends have exactly this title."""
    return edges.select(F.explode(F.array("source", "target")).alias("title")).groupBy("title").agg(F.count("*").alias("degree"))


def with_combined_degree(edges: DataFrame) -> DataFrame:
    """``edges`` with combined_degree, the sum of the degrees of both ends."""
    d = degrees(edges)
    return (
        edges.drop("combined_degree")
        .join(d.select(F.col("title").alias("source"), F.col("degree").alias("_ds")), "source")
        .join(d.select(F.col("title").alias("target"), F.col("degree").alias("_dt")), "target")
        .withColumn("combined_degree", F.col("_ds") + F.col("_dt"))
        .drop("_ds", "_dt")
    )


def merge_entities(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One entity per casefolded name, with its first spelling; units, description and degree of exactly that spelling."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("source").alias("name")), F.struct(F.lit(1).alias("end"), F.col("target").alias("name"))))
    mention = rows.select("ord", "unit_id", "evidence", ends.alias("e")).select(F.struct("ord", "e.end").alias("at"), "e.name", "unit_id", "evidence")
    spelled = mention.groupBy("name").agg(
        F.sort_array(F.collect_set("unit_id")).alias("text_unit_ids"), F.min_by("evidence", "at").alias("description"), F.min("at").alias("at")
    )
    merged = spelled.groupBy(t.casefold(F.col("name")).alias("key")).agg(F.min_by(F.struct("name", "text_unit_ids", "description", "at"), "at").alias("f"))
    named = merged.select(
        t.stable_id("ent", F.col("key")).alias("id"), F.col("f.name").alias("title"), F.lit("Entity").alias("type"), "f.description", "f.text_unit_ids",
        F.lit("").alias("enriched_description"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("category"), F.col("f.at").alias("ord"),
    )
    return named.join(degrees(edges), "title", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
