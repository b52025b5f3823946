"""Enrichment and extraction by a client."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import enrichment, extraction
from tessera.plans.index import build_index


class Scripted:
    """Answers by step; prompts that contain ``fail`` raise."""

    def __init__(self, **answers):
        self.answers = answers

    def chat_json(self, system, user, schema_hint=None):
        if "Fail" in user:
            raise TimeoutError("too slow")
        for key, value in self.answers.items():
            if f'"{key}"' in schema_hint:
                return value
        return {}


@pytest.fixture(scope="module")
def index(spark):
    docs = [("d1", "Old Mill depends on River Town. Old Mill causes River Town. Fail Point blocks River Town. River Town uses Sea Port.")]
    return build_index(spark.createDataFrame(docs, "id string, text string"), with_communities=False)


def by_pair(edges):
    return {(e.source, e.target, e.relation): e for e in edges.collect()}


def test_edge_steps(index):
    client = Scripted(questions={"questions": ["a?", "", None]}, summary={"summary": "short"}, importance={"importance": 7})
    edges = enrichment.enrich_importance(enrichment.enrich_summaries(enrichment.enrich_questions(index.edges, client), client), client)
    got = by_pair(edges)
    mill, fail = got["Old Mill", "River Town", "depends_on"], got["Fail Point", "River Town", "prevents"]
    assert (mill.generated_questions, mill.semantic_summary, mill.importance) == (["a?"], "short", 1.0)
    assert (fail.generated_questions, fail.semantic_summary, fail.importance) == ([], "", 0.5)
    odd = by_pair(enrichment.enrich_questions(index.edges, Scripted(questions={"questions": "text"})))
    assert odd["Old Mill", "River Town", "depends_on"].generated_questions == []


def test_contradictions_mark_only_listed_edges(index):
    ids = {k: e.id for k, e in by_pair(index.edges).items()}
    one = ids["Old Mill", "River Town", "causes"]
    edges = enrichment.enrich_contradictions(index.edges, Scripted(has_contradiction={"has_contradiction": True, "explanation": "clash", "conflicting_ids": [one, "other"]}))
    assert {e.id for e in edges.collect() if e.conflict_status == "contradiction"} == {one}
    calm = enrichment.enrich_contradictions(index.edges, Scripted(has_contradiction={"has_contradiction": False, "conflicting_ids": [one]}))
    assert not [e for e in calm.collect() if e.conflict_status == "contradiction"]


def test_entities_and_inference(spark, index):
    client = Scripted(category={"description": "told", "aliases": ["OM", ""], "category": "Place"}, inferred={"inferred": {"relation": "uses", "description": "so", "confidence": 0.5}})
    lone = index.entities.withColumn("title", F.when(F.col("title") == "Sea Port", "Nowhere").otherwise(F.col("title")))
    entities = {e.title: e for e in enrichment.enrich_entities(lone, index.edges, client).collect()}
    assert (entities["Old Mill"].enriched_description, entities["Old Mill"].aliases, entities["Old Mill"].category) == ("told", ["OM"], "Place")
    assert entities["Nowhere"].enriched_description == ""
    _, edges = enrichment.enrich_graph(index.entities, index.edges, client, ["infer", "unknown"])
    new = [e for e in edges.collect() if e.evidence_type == "inferred"]
    assert {(e.source, e.target, e.relation) for e in new} == {("Old Mill", "Sea Port", "uses")}
    again = enrichment.enrich_graph(index.entities, edges.withColumn("ord", F.coalesce("ord", F.struct(F.lit("z").alias("document_id"), F.lit(0).alias("position"), F.lit(1).alias("group"), F.lit(0).alias("k")))), client, ["infer"])[1]
    assert len([e for e in again.collect() if e.evidence_type == "inferred"]) == len(new)


def test_extraction_with_resume_and_errors(spark):
    units = spark.createDataFrame([("u1", "d1", 0, "The Mill feeds the Town daily."), ("u2", "d1", 1, "Fail here"), ("u3", "d1", 2, "cached text")], "id string, document_id string, position int, text string")
    docs = spark.createDataFrame([("d1", "Title")], "id string, title string")
    payload = {
        "entities": [{"name": "Mill", "type": "Place"}, {"name": ""}],
        "relationships": [
            {"source": "mill", "target": "Town", "relation": "related to", "evidence_text": "the mill FEEDS the town", "confidence": 0}, {"source": "Mill", "target": "", "relation": "x"},
            {"source": "M-I-L-L", "target": "Town", "relation": "uses", "description": "not in the text", "llm_conf": 5},
        ],
    }
    cache = spark.createDataFrame([("u3", json.dumps({"entities": [{"name": "Cached"}], "relationships": []})), ("u1", "broken")], "unit_id string, answer string")
    good, bad = enrichment.extract_with_client(units, docs, Scripted(entities=payload), cache)
    assert {r.unit_id for r in good.collect()} == {"u1", "u3"}
    assert [(r.unit_id, "too slow" in r.error) for r in bad.collect()] == [("u2", True)]
    rows = enrichment.payload_rows(good, units).orderBy("ord").collect()
    assert [(r.source, r.target, r.relation, r.evidence, r.llm_conf) for r in rows] == [
        ("Mill", "Town", "associated_with", "the mill FEEDS the town", 0.75), ("Mill", "Town", "uses", "The Mill feeds the Town daily.", 1.0),
    ]
    assert extraction.merge_edges(enrichment.payload_rows(good, units)).count() == 2
    log = spark.createDataFrame([("u1", "d1", "old"), ("u2", "d1", "old"), ("u9", "d1", "kept")], "unit_id string, document_id string, error string")
    left = {r.unit_id: r.error for r in enrichment.upsert_errors(log, bad, good).collect()}
    assert set(left) == {"u2", "u9"} and left["u9"] == "kept" and left["u2"] != "old"


@pytest.mark.parametrize("answer", ["[]", '{"entities": []}', '{"entities": [], "relationships": []}', '{"entities": [{"name": " "}], "relationships": [{"source": "a"}]}', "x"])
def test_payloads_without_good_rows_are_errors(spark, answer):
    df = spark.createDataFrame([("u", answer, None)], "unit_id string, answer string, error string")
    row = enrichment.validate_payload(df).first()
    assert row.payload is None and row.error


# --- asked once -------------------------------------------------------------------------------------------


class Counting:
    """Notes every call in a folder, as calls come from workers; ``fails``: how many calls fail before all others are answered."""

    def __init__(self, folder, fails=0, dies_at=None):
        self.folder, self.fails, self.dies_at = str(folder), fails, dies_at

    def chat_json(self, system, user, schema_hint=None):
        import os
        import uuid

        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write(user)
        n = len(os.listdir(self.folder))
        if self.dies_at and n >= self.dies_at:
            os._exit(1)
        if n <= self.fails:
            raise TimeoutError("busy")
        if '"entities"' in schema_hint:
            name = user.split("\nText:\n")[1].split()[0]
            return {"entities": [], "relationships": [{"source": name, "target": "Town", "relation": "uses"}]}
        return enrichment.RuleClient().chat_json(system, user, schema_hint)


def calls(folder):
    return [x.read_text() for x in folder.iterdir()]


def units_and_documents(spark, n):
    units = spark.createDataFrame([(f"u{i}", "d1", i, f"Name{i} is here") for i in range(n)], "id string, document_id string, position int, text string").repartition(4)
    return units, spark.createDataFrame([("d1", "Title")], "id string, title string")


def test_extraction_asks_once_and_loses_no_unit(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    units, docs = units_and_documents(spark, 20)
    store = enrichment.Answers(spark, f"{tmp_path}/answers")
    good, bad = enrichment.extract_with_client(units, docs, Counting(folder, fails=5), answers=store)
    failed = bad.count()  # calls run beside each other, so the number of those among the first five varies
    assert len(calls(folder)) == 20 and 1 <= failed <= 5 and good.count() == 20 - failed and {r.error for r in bad.collect()} == {"TimeoutError: busy"}
    assert good.select("unit_id").union(bad.select("unit_id")).distinct().count() == 20 and len(calls(folder)) == 20
    # the next run asks for what failed, and for nothing else
    again = enrichment.extract_with_client(units, docs, Counting(folder), answers=enrichment.Answers(spark, f"{tmp_path}/answers"))
    assert (again[0].count(), again[1].count()) == (20, 0) and len(calls(folder)) == 20 + failed
    enrichment.extract_with_client(units, docs, Counting(folder), answers=enrichment.Answers(spark, f"{tmp_path}/answers"))
    assert len(calls(folder)) == 20 + failed
    enrichment.extract_with_client(units, docs, Counting(folder), answers=enrichment.Answers(spark, f"{tmp_path}/answers", resume=False))
    assert len(calls(folder)) == 40 + failed


def test_a_killed_run_leaves_its_commits(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    units, docs = units_and_documents(spark, 60)
    store = enrichment.Answers(spark, f"{tmp_path}/answers", per_commit=10)
    with pytest.raises(Exception):
        enrichment.extract_with_client(units, docs, Counting(folder, dies_at=35), answers=store)
    kept = {r.digest for r in store.rows().collect()}
    lost = len(calls(folder)) - len(kept)
    assert 10 <= len(kept) < 60
    for f in folder.iterdir():
        f.unlink()
    good, bad = enrichment.extract_with_client(units, docs, Counting(folder), answers=enrichment.Answers(spark, f"{tmp_path}/answers"))
    assert (good.count(), bad.count()) == (60, 0) and len(calls(folder)) == 60 - len(kept) and lost < 60


def test_invalid_answers_are_asked_for_again(spark, tmp_path):
    units, docs = units_and_documents(spark, 3)
    bad = enrichment.extract_with_client(units, docs, Scripted(entities={"entities": []}), answers=enrichment.Answers(spark, f"{tmp_path}/a"))[1]
    assert bad.count() == 3
    good = enrichment.extract_with_client(units, docs, Scripted(entities={"entities": [{"name": "A"}], "relationships": []}), answers=enrichment.Answers(spark, f"{tmp_path}/a"))[0]
    assert good.count() == 3


def test_enrichment_asks_once_a_row_and_step(spark, index, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    store = enrichment.Answers(spark, f"{tmp_path}/answers")
    entities, edges = enrichment.enrich_graph(index.entities, index.edges, Counting(folder), answers=store)
    for _ in range(2):
        edges.collect(), entities.collect(), edges.groupBy("relation").count().collect()
    asked = {r.step: r["count"] for r in store.rows().groupBy("step").count().collect()}
    n = index.edges.count()
    assert [asked[s] for s in ("questions", "summaries", "importance")] == [n] * 3 and asked["entities"] == index.entities.count()
    assert len(calls(folder)) == sum(asked.values())
    before = sorted(map(repr, edges.collect()))
    _, again = enrichment.enrich_graph(index.entities, index.edges, Counting(folder), answers=enrichment.Answers(spark, f"{tmp_path}/answers"))
    assert sorted(map(repr, again.collect())) == before and len(calls(folder)) == sum(asked.values())


def test_attempts_are_logged(spark, tmp_path):
    from tessera.operators.client import ServiceClient, ServiceSettings

    class Flaky:
        def __init__(self):
            self.n = 0

        def __call__(self, url, headers, payload, timeout):
            user = payload["messages"][1]["content"]
            if "Name1 " in user or ("Name2 " in user and "could not be read" not in user):
                return {"choices": [{"message": {"content": "no json"}, "finish_reason": "stop"}]}
            return {"choices": [{"message": {"content": json.dumps({"entities": [{"name": "A"}], "relationships": []})}, "finish_reason": "stop"}]}

    units, docs = units_and_documents(spark, 3)
    store = enrichment.Answers(spark, f"{tmp_path}/a")
    client = ServiceClient(ServiceSettings(api_key="k", workers=2), Flaky(), None, float)
    good, bad = enrichment.extract_with_client(units, docs, client, answers=store)
    assert ({r.unit_id for r in good.collect()}, {r.unit_id for r in bad.collect()}) == ({"u0", "u2"}, {"u1"})
    log = sorted((r.status, r.attempt) for r in store.attempts().collect())
    assert log == [("malformed", 1), ("malformed", 1), ("malformed", 2), ("malformed", 3), ("success", 1), ("success", 2)]


def test_a_hub_tells_its_first_facts(spark, index, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    numbers = spark.range(50).select(F.col("id").alias("n"))
    hub = index.edges.limit(1).crossJoin(numbers).withColumns({"id": F.format_string("e%02d", "n"), "source": F.lit("Old Mill"), "description": F.format_string("fact %02d", "n")}).drop("n")
    assert enrichment.enrich_entities(index.entities.where("title = 'Old Mill'"), hub, Counting(folder)).count() == 1
    (prompt,) = calls(folder)
    assert [x[-2:] for x in prompt.split("\n") if "fact" in x] == [f"{i:02d}" for i in range(10)]
