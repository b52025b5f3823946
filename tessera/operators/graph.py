"""Graph operators over the edge table: paths, inference, aliases, components, communities, subgraphs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import rules as r
from ..functions import text as t
from ..storage import materialize


def two_hop_paths(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(first, second, source, via, target): pairs of edges where the second begins, letter by letter, where the first ends.

    No edge twice and no vertex twice.  ``seeds`` (id) restricts the first edges.
    """
    a = edges.select(F.col("id").alias("first"), "source", F.col("target").alias("via"))
    if seeds is not None:
        a = a.join(seeds.select(F.col("id").alias("first")), "first", "left_semi")
    b = edges.select(F.col("id").alias("second"), F.col("source").alias("via"), "target")
    return a.join(b, "via").where("first <> second and source <> target and via <> target").select("first", "second", "source", "via", "target")


def paths(edges: DataFrame, max_hops: int = 2, seeds: DataFrame | None = None) -> DataFrame:
    """(ids, nodes): paths of two to ``max_hops`` edges without a repeated edge or target vertex."""
    step = edges.select(F.col("id").alias("_id"), F.col("source").alias("_s"), F.col("target").alias("_t"))
    start = edges if seeds is None else edges.join(seeds.select("id"), "id", "left_semi")
    current = start.select(F.array("id").alias("ids"), F.array("source", "target").alias("nodes"))
    out = None
    for _ in range(max_hops - 1):
        joined = current.join(step, F.element_at("nodes", -1) == F.col("_s"))
        free = ~F.array_contains("ids", F.col("_id")) & ~F.array_contains("nodes", F.col("_t"))
        current = joined.where(free).select(F.concat("ids", F.array("_id")).alias("ids"), F.concat("nodes", F.array("_t")).alias("nodes"))
        out = current if out is None else out.unionByName(current)
    return out


def inference_pairs(edges: DataFrame, per_seed: int = 5, limit: int = 200) -> DataFrame:
    """(seed_id, next_id, k): seeds by falling reliability (then order), each with its first successors, ``limit`` in all.

    Every seed with a successor gives a row, so the first ``limit`` of these seeds are all that can be needed; the others are not
    joined with their successors.
    """
    a = edges.select(F.col("id").alias("seed_id"), F.col("reliability").alias("_rel"), F.col("ord").alias("_ord"), t.casefold(F.col("target")).alias("_node"))
    b = edges.select(F.col("id").alias("next_id"), t.casefold(F.col("source")).alias("_node"), F.col("ord").alias("_next"))
    seeds = a.join(b.select("_node").distinct(), "_node", "left_semi").orderBy(F.desc("_rel"), "_ord", "seed_id").limit(limit)
    seeds = seeds.select("seed_id", "_node", F.row_number().over(Window.orderBy(F.desc("_rel"), "_ord", "seed_id")).alias("_place"))  # ``limit`` rows
    seeds = materialize(seeds, "seeds")
    near = b.join(F.broadcast(seeds.select("_node").distinct()), "_node", "left_semi")  # ``limit`` rows
    first = near.withColumn("n", F.row_number().over(Window.partitionBy("_node").orderBy("_next", "next_id"))).where(F.col("n") <= per_seed)
    joined = first.join(F.broadcast(seeds), "_node").orderBy("_place", "n").limit(limit)  # ``limit`` rows
    return joined.select("seed_id", "next_id", F.row_number().over(Window.orderBy("_place", "n")).alias("k"))  # ``limit`` rows


def infer_edges(edges: DataFrame, answers: DataFrame) -> DataFrame:
    """New edges from ``answers`` (seed_id, next_id, k, relation, description, confidence): those whose key is not there yet.

    The source is the seed's, the target the successor's.  Of several answers with one key the first (by k) counts.
    """
    a = edges.select(
        F.col("id").alias("seed_id"), F.col("source"), F.col("reliability").alias("_r1"), F.col("source_docs").alias("_d1"), F.col("text_unit_ids").alias("_u1"), F.col("edge_text").alias("_t1")
    )
    b = edges.select(
        F.col("id").alias("next_id"), F.col("target"), F.col("reliability").alias("_r2"), F.col("source_docs").alias("_d2"), F.col("text_unit_ids").alias("_u2"), F.col("edge_text").alias("_t2")
    )
    told = answers.withColumn("norm", r.normalize_relation(t.nvl("relation", "associated_with"))).drop("relation")
    joined = told.join(a, "seed_id").join(b, "next_id").withColumns(
        {"relation": F.col("norm.relation"), "ontology_ok": F.col("norm.ontology_ok"), "_s": t.casefold(F.col("source")), "_t": t.casefold(F.col("target"))}
    )
    known = edges.select(t.casefold(F.col("source")).alias("_s"), t.casefold(F.col("target")).alias("_t"), "relation").distinct()
    fresh = joined.join(known, ["_s", "_t", "relation"], "left_anti")
    first = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("_s", "_t", "relation").orderBy("k"))).where("_n = 1")
    confidence = F.coalesce(F.col("confidence"), F.lit(0.5))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    text = t.nvl("description")
    return first.select(
        t.stable_id("inferred", F.col("_s"), F.col("_t"), F.col("relation")).alias("id"), "source", "target", "relation", text.alias("description"),
        F.lit(1.0).alias("weight"), F.sort_array(F.array_union("_u1", "_u2")).alias("text_unit_ids"),
        F.concat(F.lit("Inferred from: "), "_t1", F.lit(" + "), "_t2").alias("evidence_text"), F.lit("inferred").alias("evidence_type"),
        F.sort_array(F.array_union("_d1", "_d2")).alias("source_docs"), "ontology_ok", sure.alias("llm_conf"),
        F.concat("source", F.lit(" "), F.replace("relation", F.lit("_"), F.lit(" ")), F.lit(" "), "target", F.lit(". "), text).alias("edge_text"),
        F.array(F.lit("causal"), F.lit("exploratory")).alias("useful_for"), F.lit("ok").alias("conflict_status"),
        (F.least("_r1", "_r2") * sure).alias("reliability"), (confidence * 0.8).alias("importance"),
    )


def contradiction_groups(edges: DataFrame) -> DataFrame:
    """(source_key, target_key, edge_ids, n): pairs of entities with two edges or more."""
    keyed = edges.groupBy(t.casefold(F.col("source")).alias("source_key"), t.casefold(F.col("target")).alias("target_key"))
    return keyed.agg(F.sort_array(F.collect_list("id")).alias("edge_ids"), F.count("*").alias("n")).where("n >= 2")


def alias_map(entities: DataFrame) -> DataFrame:
    """(key, title): which title a name stands for; entities of high degree first, titles before aliases, then order."""
    named = F.explode(F.concat(F.array(F.struct(F.lit(0).alias("i"), F.col("title").alias("name"))), F.transform("aliases", lambda x, i: F.struct((i + 1).alias("i"), x.alias("name")))))
    rows = entities.select("title", "degree", "ord", named.alias("a")).select(t.entity_key(F.col("a.name")).alias("key"), "title", F.struct(-F.col("degree"), "ord", "a.i").alias("at"))
    return rows.groupBy("key").agg(F.min_by("title", "at").alias("title"))


def resolve_aliases(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges with aliases replaced and what has become equal merged; edges to themselves are dropped."""
    known = alias_map(entities)
    name = lambda df, column: (
        df.withColumn("_k", t.entity_key(F.col(column))).join(known.select(F.col("key").alias("_k"), F.col("title").alias("_t")), "_k", "left").withColumn(column, F.coalesce("_t", column)).drop("_k", "_t")
    )
    renamed = name(entities.withColumn("old", F.col("title")), "title").withColumn("key", t.entity_key(F.col("title")))
    first = F.min_by(F.struct("id", "title", "type", "description", "category", "ord", "old", "aliases"), "ord")
    merged = renamed.groupBy("key").agg(
        first.alias("f"), F.count("*").alias("n"), F.sum("degree").alias("degree"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat("aliases", F.array("old")))))).alias("every"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("text_unit_ids")))).alias("text_unit_ids"),
        F.min_by("enriched_description", F.when(F.col("enriched_description") != "", F.col("ord"))).alias("enriched_description"),
    )
    own_title = F.array_except(F.col("every"), F.array("f.old"))
    out = merged.select(
        "f.id", "f.title", "f.type", "f.description", "text_unit_ids", "degree", t.nvl("enriched_description").alias("enriched_description"),
        F.when(F.col("n") > 1, F.array_sort(F.array_union(own_title, F.col("f.aliases")))).otherwise(F.col("f.aliases")).alias("aliases"), "f.category", "f.ord",
    )
    moved = name(name(edges, "source"), "target").withColumns({"_s": t.entity_key(F.col("source")), "_t": t.entity_key(F.col("target"))}).where("_s <> _t")
    rest = [c for c in edges.columns if c not in ("relation", "source_docs", "text_unit_ids", "weight")]
    again = moved.groupBy("_s", "_t", "relation").agg(
        F.min_by(F.struct(*rest, "source_docs", "text_unit_ids"), "ord").alias("f"), F.count("*").alias("n"), F.sum("weight").alias("weight"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_docs")))).alias("docs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("text_unit_ids")))).alias("units"),
    )
    both = again.select(
        *[F.col(f"f.{c}").alias(c) for c in rest], "relation", "weight",
        F.when(F.col("n") > 1, F.col("docs")).otherwise(F.col("f.source_docs")).alias("source_docs"),
        F.when(F.col("n") > 1, F.col("units")).otherwise(F.col("f.text_unit_ids")).alias("text_unit_ids"),
    )
    return out, both


def top_subgraph(entities: DataFrame, edges: DataFrame, max_nodes: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes (title, degree), edges): the nodes of largest degree and the edges among them.  Ends without an entity are nodes too."""
    titles = entities.select("title").unionByName(edges.select(F.explode(F.array("source", "target")).alias("title"))).distinct()
    loops = edges.select(F.explode(F.array("source", "target")).alias("title")).groupBy("title").agg(F.count("*").alias("degree"))
    ranked = titles.join(loops, "title", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    nodes = ranked.orderBy(F.desc("degree"), "title").limit(max_nodes)
    kept = nodes.select("title")
    inside = edges.join(kept.withColumnRenamed("title", "source"), "source", "left_semi").join(kept.withColumnRenamed("title", "target"), "target", "left_semi")
    return nodes, inside


#: Edges up to this number are solved in one task; more go through rounds over the cluster.
LOCAL_EDGES = 200_000


def linked_components(edges: DataFrame, left: str, right: str, local_edges: int = 0, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge (columns ``left``, ``right``) to another node; component: the smallest node reachable.

    Large-star and small-star rounds.  Each ends in a table in the shared folder, so the plan stays short and a
    lost executor costs a reread; whether anything has changed is counted while the table is written.
    Minima are aggregated before the shuffle, and the joins are plain equi-joins, which adaptive execution splits
    where one node has very many neighbours.  Self loops and null ends are ignored; an empty edge table gives
    an empty result.  A table of at most ``local_edges`` edges is solved in one task instead, with the same result.
    """
    a, b = F.col(left), F.col(right)
    ends = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current, state = _counted(ends)
    if 0 < state[0] <= local_edges:
        schema = current.select(F.col("u").alias("node"), F.col("v").alias("component")).schema
        return current.coalesce(1).mapInPandas(_joined_up, schema)
    seen = None
    for _ in range(max_rounds):
        if state == seen or not state[0]:
            break
        seen = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current, state = _counted(star.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, with their number and a sum of hashes that tells tables apart."""
    told = Observation()
    written = materialize(edges.observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "components")
    return written, (told.get.get("n", 0), told.get.get("h"))


def _joined_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict = {}

    def find(x):
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = above
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            up[max(a, b)] = min(a, b)
    yield pd.DataFrame([(x, find(x)) for x in list(up)], columns=["node", "component"])


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) of all ends of edges (source, target): the smallest name reachable."""
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    found = linked_components(edges, "source", "target", local_edges)
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
