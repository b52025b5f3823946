"""Edge reliability from evidence, ontology, structure and consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# The weights of the four scores.
WEIGHTS = {"evidence": 0.35, "ontology": 0.25, "structural": 0.20, "consistency": 0.20}


def clip(value: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6)


def calibrate_edges(edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``edges`` with evidence_score, ontology_score, structural_score, consistency_score, conflict_status and reliability.

    Edges are dealt once, by their casefolded ends, and pairs of ends with their relations are counted there.  Relation frequencies, a
    row for each name of the ontology, are sent to all tasks: a join would bring all edges of a relation into one.  The number of
    edges and the largest degree are one row, made of these.  If no edge has a degree, centrality is 0.  How well the evidence covers
    an edge is found before, so that the texts are dealt only for those who ask for them.
    """
    w = weights or WEIGHTS
    total = sum(w.values())
    share = {k: v / total for k, v in w.items()}
    alias = F.array_distinct(t.content_tokens(F.concat_ws(" ", "source", "target", "relation")))
    coverage = F.size(F.array_intersect(alias, t.content_tokens(F.col("evidence_text")))) / F.greatest(F.lit(1), F.size(alias))
    keyed = edges.withColumns({"_s": t.casefold(F.col("source")), "_t": t.casefold(F.col("target")), "_coverage": coverage, "_docs": F.size("source_docs")})
    counts = edges.groupBy("relation").agg(F.count("*").alias("_rel"), F.max("combined_degree").alias("_most"))
    overall = counts.agg(F.sum("_rel").alias("_n"), F.max("_most").alias("_max"))
    pair = keyed.withColumn("_pair", F.count("*").over(Window.partitionBy("_s", "_t"))).withColumn("_same", F.count("*").over(Window.partitionBy("_s", "_t", "relation")))
    joined = pair.join(F.broadcast(counts.drop("_most")), "relation").crossJoin(F.broadcast(overall))  # one row
    explicit = F.when(F.col("evidence_type") == "explicit", 1.0).when(F.col("evidence_type") == "table", 0.7).otherwise(0.4)
    redundancy = F.least(F.lit(1.0), 0.5 + 0.2 * F.greatest(F.lit(0), F.col("_docs") - 1))
    centrality = F.when(F.col("_max") > 0, F.log1p("combined_degree") / F.log1p("_max")).otherwise(0.0)
    frequency = F.log1p("_rel") / F.log1p(F.greatest(F.lit(1), F.col("_n")))
    conflicts = F.col("_pair") - F.col("_same")
    bad = F.col("conflict_status") == "contradiction"
    scored = joined.withColumns(
        {
            "evidence_score": clip(0.4 * F.col("llm_conf") + 0.3 * F.col("_coverage") + 0.2 * explicit + 0.1 * redundancy),
            "ontology_score": F.when(F.col("ontology_ok"), 1.0).otherwise(0.0),
            "structural_score": clip(0.55 * centrality + 0.45 * frequency),
            "consistency_score": clip(1.0 - F.when(bad, 0.5).otherwise(0.0) - F.least(F.lit(0.75), 0.25 * conflicts)),
            "conflict_status": F.when(bad, "contradiction").when(conflicts > 0, "review").otherwise("ok"),
        }
    )
    total_score = sum(F.lit(share[k]) * F.col(f"{k}_score") for k in ("evidence", "ontology", "structural", "consistency"))
    return scored.withColumn("reliability", clip(total_score)).drop("_s", "_t", "_coverage", "_docs", "_rel", "_pair", "_same", "_n", "_max")
