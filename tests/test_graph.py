"""Chunks, extraction, calibration and graph operators on small graphs."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import calibration, chunking, communities, extraction, graph
from tessera.plans.index import Index, build_index


def documents(spark, rows):
    return spark.createDataFrame(rows, "id string, text string")


def test_chunks(spark):
    df = documents(spark, [("a", " ".join(map(str, range(50)))), ("b", "x"), ("c", " "), ("d", None), ("e", " ".join("y" * 20)), ("f", " ".join("z" * 21))])
    got = {}
    for r in chunking.chunk_documents(df, 20, 5).collect():
        got.setdefault(r.document_id, {})[r.position] = r.text.split()
    words = list(map(str, range(50)))
    assert got["a"] == {0: words[:20], 1: words[15:35], 2: words[30:50]}
    assert {k: len(v) for k, v in got.items()} == {"a": 3, "b": 1, "e": 1, "f": 2}
    with pytest.raises(ValueError):
        chunking.chunk_documents(df, 5, 5)


def rows_of(spark, rows, supplied=None):
    units = chunking.chunk_documents(documents(spark, rows), 600, 100)
    given = spark.createDataFrame(supplied, f"id string, relationships {extraction.SUPPLIED}") if supplied else None
    return extraction.relation_rows(units, given)


def test_extraction_and_merging(spark):
    rows = rows_of(spark, [("d1", "The Mill depends on River. Nothing here. The Mill depends on River."), ("d2", "THE MILL requires RIVER. Old Town met New Town. Alone came.")])
    edges = {(e.source, e.target, e.relation): e for e in extraction.with_combined_degree(extraction.merge_edges(rows)).collect()}
    assert set(edges) == {("The Mill", "River", "depends_on"), ("Old Town", "New Town", "associated_with")}
    mill, town = edges["The Mill", "River", "depends_on"], edges["Old Town", "New Town", "associated_with"]
    assert (mill.weight, mill.source_docs, len(mill.text_unit_ids), mill.evidence_type, mill.llm_conf, mill.useful_for) == (3.0, ["d1", "d2"], 2, "explicit", 0.75, ["causal", "diagnostic"])
    assert (town.evidence_type, town.llm_conf, town.ontology_ok, town.combined_degree) == ("implicit", 0.45, False, 2)
    entities = {e.title: e for e in extraction.merge_entities(rows, extraction.merge_edges(rows)).collect()}
    assert set(entities) == {"The Mill", "River", "Old Town", "New Town"} and len(entities["The Mill"].text_unit_ids) == 1 and entities["The Mill"].degree == 1


def test_supplied_relationships_count_for_every_unit(spark):
    text = " ".join(["word"] * 900)
    rows = rows_of(spark, [("d", text), ("e", "Up North causes Down South.")], [("d", [("A", "B", "hosts", None), ("C", "C", "uses", "self")]), ("e", [])])
    edges = {e.source: e for e in extraction.merge_edges(rows).collect()}
    assert set(edges) == {"A", "Up North"} and edges["A"].weight == 2.0 and edges["A"].llm_conf == 0.85 and edges["A"].evidence_type == "explicit"


def edge_table(spark, rows):
    """Edges from (source, target, relation, reliability)."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, source string, target string, relation string, reliability double")
    return df.withColumns(
        {
            "id": F.concat(F.lit("e"), "ord"), "weight": F.lit(1.0), "text_unit_ids": F.array(F.concat(F.lit("u"), "ord")), "source_docs": F.array(F.concat(F.lit("d"), "ord")),
            "evidence_text": F.concat_ws(" ", "source", "relation", "target"), "description": F.concat_ws(" ", "source", "target"), "evidence_type": F.lit("explicit"), "llm_conf": F.lit(0.75),
            "ontology_ok": F.lit(True), "conflict_status": F.lit("ok"), "edge_text": F.concat_ws(" ", "source", "target"), "useful_for": F.array(F.lit("factual")),
            "generated_questions": F.array().cast("array<string>"), "semantic_summary": F.lit(""), "contradiction_info": F.lit(""), "importance": F.lit(0.5),
        }
    )


def test_calibration(spark):
    edges = edge_table(spark, [("Big A", "B", "hosts", 0.0), ("big a", "b", "uses", 0.0), ("C", "D", "hosts", 0.0)])
    got = {e.id: e for e in calibration.calibrate_edges(extraction.with_combined_degree(edges)).collect()}
    assert got["e0"].conflict_status == "review" and got["e0"].consistency_score == 0.75 and got["e2"].consistency_score == 1.0
    assert got["e0"].evidence_score == pytest.approx(0.4 * 0.75 + 0.3 + 0.2 + 0.05)
    assert all(0 <= e.reliability <= 1 for e in got.values())
    bad = edges.withColumn("conflict_status", F.when(F.col("id") == "e0", "contradiction").otherwise("ok"))
    marked = {e.id: e for e in calibration.calibrate_edges(extraction.with_combined_degree(bad), {"evidence": 1, "ontology": 1, "structural": 1, "consistency": 1}).collect()}
    assert marked["e0"].conflict_status == "contradiction" and marked["e0"].consistency_score == 0.25
    none = calibration.calibrate_edges(edges.withColumn("combined_degree", F.lit(0))).collect()
    assert all(e.structural_score >= 0 for e in none)


def test_paths_and_inference(spark):
    edges = edge_table(spark, [("A", "B", "uses", 0.9), ("B", "C", "uses", 0.5), ("C", "A", "uses", 0.7), ("B", "D", "hosts", 0.4), ("A", "C", "associated_with", 0.1)])
    two = {tuple(p.ids) for p in graph.paths(edges, 2).collect()}
    assert two == {("e0", "e1"), ("e0", "e3"), ("e1", "e2"), ("e2", "e0"), ("e4", "e2")} - {("e4", "e2")}
    assert {tuple(p.ids) for p in graph.paths(edges, 3).collect()} - two == {("e2", "e0", "e3")}
    assert {(p.first, p.second) for p in graph.two_hop_paths(edges).collect()} == two
    pairs = [(p.seed_id, p.next_id) for p in graph.inference_pairs(edges, limit=3).orderBy("k").collect()]
    assert pairs == [("e0", "e1"), ("e0", "e3"), ("e2", "e0")]
    answers = spark.createDataFrame([("e0", "e1", 1, "related to", "so", 0.8), ("e0", "e3", 2, "uses", "so", 1.5), ("e2", "e0", 3, "uses", "x", None)], "seed_id string, next_id string, k int, relation string, description string, confidence double")
    new = {(e.source, e.target): e for e in graph.infer_edges(edges, answers).collect()}
    assert set(new) == {("A", "D"), ("C", "B")}  # A to C is there already
    assert new["A", "D"].reliability == pytest.approx(0.4) and new["A", "D"].importance == pytest.approx(1.2) and new["A", "D"].llm_conf == 1.0
    assert new["C", "B"].llm_conf == 0.5 and new["C", "B"].source_docs == ["d0", "d2"]


def test_aliases(spark):
    edges = edge_table(spark, [("IBM", "Acme", "uses", 0.5), ("Big Blue", "Acme", "uses", 0.5), ("Big-Blue", "IBM", "uses", 0.5)])
    entities = spark.createDataFrame(
        [(1, "n1", "IBM", ["Big Blue"], ["u1"], 3, ""), (2, "n2", "Big Blue", [], ["u0"], 1, "described"), (3, "n3", "Acme", [], ["u9"], 2, "")],
        "ord int, id string, title string, aliases array<string>, text_unit_ids array<string>, degree long, enriched_description string",
    ).withColumns({"type": F.lit("Entity"), "description": F.lit(""), "category": F.lit("")})
    nodes, links = graph.resolve_aliases(entities, edges)
    got = {n.title: n for n in nodes.collect()}
    assert set(got) == {"IBM", "Acme"} and got["IBM"].degree == 4 and got["IBM"].text_unit_ids == ["u0", "u1"] and got["IBM"].aliases == ["Big Blue"] and got["IBM"].enriched_description == "described"
    (link,) = links.collect()
    assert (link.source, link.target, link.weight, link.source_docs) == ("IBM", "Acme", 2.0, ["d0", "d1"])


def modularity(links, groups, two_m):
    of = {x: i for i, g in enumerate(groups) for x in g}
    inside, degree = [0.0] * len(groups), [0.0] * len(groups)
    for (a, b), w in links.items():
        degree[of[a]] += w
        degree[of[b]] += w
        if of[a] == of[b]:
            inside[of[a]] += 2 * w
    return sum(i / two_m - (d / two_m) ** 2 for i, d in zip(inside, degree, strict=True))


@pytest.mark.parametrize("seed", range(5))
def test_greedy_modularity_stops_at_a_local_best(seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(12)]
    links = {p: r.choice([0.2, 0.5, 1.0]) for p in itertools.combinations(names, 2) if r.random() < (0.7 if (names.index(p[0]) < 6) == (names.index(p[1]) < 6) else 0.08)}
    two_m = 2 * sum(links.values())
    groups = communities.greedy_modularity(links, two_m)
    assert sorted(x for g in groups for x in g) == sorted({x for p in links for x in p})
    best = modularity(links, groups, two_m)
    assert best >= modularity(links, [[x] for g in groups for x in g], two_m)
    for a, b in itertools.combinations(range(len(groups)), 2):
        joined = [g for i, g in enumerate(groups) if i not in (a, b)] + [groups[a] + groups[b]]
        assert modularity(links, joined, two_m) <= best + 1e-12


def test_communities_and_reports(spark):
    rows = [("A", "B", "uses", 0.9), ("B", "C", "uses", 0.8), ("A", "C", "uses", 0.7), ("X", "Y", "hosts", 0.5), ("Y", "X", "hosts", 0.4)]
    edges = edge_table(spark, rows)
    entities = spark.createDataFrame([(x,) for x in "ABCXYZ"], "title string")
    members = communities.community_members(entities, edges)
    assert {tuple(m.members) for m in members.collect()} == {("A", "B", "C"), ("X", "Y"), ("Z",)}
    found = {tuple(c.entity_ids): c for c in communities.communities(members, edges).collect()}
    assert found["A", "B", "C"].edge_ids == ["e0", "e1", "e2"] and found[("Z",)].edge_ids == []
    told = {tuple(x.entity_ids): x for x in communities.reports(members, edges).collect()}
    assert told["A", "B", "C"].edge_ids == ["e0", "e1", "e2"] and told["A", "B", "C"].reliability == pytest.approx(0.8)
    assert told["X", "Y"].summary == "X Y Y X" and told[("Z",)].summary == "Entity: Z." and told[("Z",)].reliability == 0.5
    assert told["A", "B", "C"].community_id == found["A", "B", "C"].id
    few = communities.reports(members, edges, facts=1)
    assert {tuple(x.entity_ids): len(x.edge_ids) for x in few.collect()} == {("A", "B", "C"): 1, ("X", "Y"): 1, ("Z",): 0}


def test_top_subgraph(spark):
    edges = edge_table(spark, [("A", "B", "uses", 1.0), ("A", "C", "uses", 1.0), ("C", "D", "uses", 1.0)])
    nodes, inside = graph.top_subgraph(spark.createDataFrame([("A",), ("Lone",)], "title string"), edges, 2)
    assert [n.title for n in nodes.collect()] == ["A", "C"] and [e.id for e in inside.collect()] == ["e1"]


def test_index_round_trip(spark, tmp_path):
    index = build_index(documents(spark, [("d1", "The Mill depends on River. River causes Flood."), ("d2", "Plain words.")]))
    index.save(str(tmp_path / "ix"))
    again = Index.load(spark, str(tmp_path / "ix"))
    assert again.edges.count() == 2 and again.documents.count() == 2 and again.reports.count() == 1
    assert {e.reliability for e in again.visible(calibrated=False).edges.collect()} == {1.0}
    with pytest.raises(FileNotFoundError):
        Index.load(spark, str(tmp_path / "none"))


def test_components_in_one_task_and_by_rounds_agree(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 470)] + [(500, k) for k in range(501, 560)] + [(9, 9), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        stack = [] if x in want else [x]
        while stack:
            y = stack.pop()
            if y not in want:
                want[y] = x
                stack += near[y]
    for local in (0, 10_000):
        assert {x.node: x.component for x in graph.linked_components(df, "a", "b", local).collect()} == want
        assert graph.linked_components(df.where("a > 1000"), "a", "b", local).collect() == []


def planted(seed, groups, size, inner=0.5, outer=0.01):
    """Links of a connected graph of planted groups."""
    r = random.Random(seed)
    names = [f"g{g:02d}n{i:02d}" for g in range(groups) for i in range(size)]
    links = {p: 1.0 for p in itertools.combinations(names, 2) if r.random() < (inner if p[0][:3] == p[1][:3] else outer)}
    return links | {(names[i], names[i + 1]): 1.0 for i in range(len(names) - 1)}


@pytest.mark.parametrize("links", [planted(1, 6, 12), {("hub", f"leaf{i:03d}"): 0.5 for i in range(80)} | {(f"leaf{i:03d}", f"leaf{i + 1:03d}"): 1.0 for i in range(0, 80, 4)}, {(f"p{i:03d}", f"p{i + 1:03d}"): 1.0 for i in range(70)}])
def test_large_components_are_contracted(spark, links):
    two_m = 2 * sum(links.values())
    edges = edge_table(spark, [(a, b, "uses", w) for (a, b), w in links.items()])
    nodes = sorted({x for p in links for x in p})
    entities = spark.createDataFrame([(x,) for x in [*nodes, "Alone"]], "title string")
    direct = modularity(links, communities.greedy_modularity(links, two_m), two_m)
    for large in (20,):
        got = {r.title: r.community for r in communities.community_labels(entities, edges, large).collect()}
        assert sorted(got) == sorted([*nodes, "Alone"]) and got["Alone"] == "Alone"
        groups = {}
        for x in nodes:
            groups.setdefault(got[x], []).append(x)
        assert all(c == min(g) for c, g in groups.items())
        assert modularity(links, list(groups.values()), two_m) >= 0.85 * direct
    plain = {r.title: r.community for r in communities.community_labels(entities, edges).collect()}
    assert plain == {x: g[0] for g in communities.greedy_modularity(links, two_m) for x in g} | {"Alone": "Alone"}


def test_greedy_modularity_takes_the_best_union_each_time():
    """Against all pairs of groups weighed anew before each union."""
    def plain(links, two_m):
        groups = {x: {x} for pair in links for x in pair}
        degree = {x: sum(w * ((a == x) + (b == x)) for (a, b), w in links.items()) for x in groups}
        while True:
            between = {}
            of = {x: g for g, xs in groups.items() for x in xs}
            for (a, b), w in links.items():
                if of[a] != of[b]:
                    pair = tuple(sorted((of[a], of[b])))
                    between[pair] = between.get(pair, 0.0) + w
            found = min(((-(w / two_m * 2 - 2 * degree[a] * degree[b] / two_m**2), a, b) for (a, b), w in between.items()), default=(1.0,))
            if found[0] > 0:
                return sorted(sorted(g) for g in groups.values())
            groups[found[1]] |= groups.pop(found[2])
            degree[found[1]] += degree.pop(found[2])

    r = random.Random(4)
    for t in range(60):
        names = [f"n{k}" for k in r.sample(range(100), r.randrange(2, 25))]
        links = {tuple(sorted((names[0] if r.random() < 0.3 else r.choice(names), r.choice(names)))): r.choice([0.25, 0.5, 1.0, 2.0]) for _ in range(r.randrange(1, 60))}
        two_m = 2 * sum(links.values()) * r.choice([1, 2])
        assert communities.greedy_modularity(links, two_m) == plain(links, two_m), t


def test_greedy_modularity_of_a_hub_is_quick():
    n = 6000
    links = {("hub", f"v{k:05d}") if k % 2 else (f"a{k:05d}", "hub"): 1 + k % 7 / 10 for k in range(n)}
    began = time.time()
    assert communities.greedy_modularity(links, 8 * sum(links.values())) == [sorted({x for pair in links for x in pair})]
    assert time.time() - began < 30  # weighing all links of the hub at each union took minutes


def test_calibration_does_not_deal_edges_by_relation(spark):
    edges = extraction.with_combined_degree(extraction.merge_edges(extraction.relation_rows(chunking.chunk_documents(documents(spark, [("a", "Alpha Works uses Beta Works.")])))))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = calibration.calibrate_edges(edges)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin [relation" not in plan and "BroadcastHashJoin [relation" in plan
