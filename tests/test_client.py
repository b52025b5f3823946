"""The service client, extraction and enrichment with it, and what is kept between runs."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import cli, sinks
from tessera.functions.jsonrepair import close_truncated, parse_object
from tessera.operators import client, enrichment
from tessera.plans.context import HYBRID, hybrid_weights
from tessera.plans.index import Extraction, Index, build_index, enrich_index


class Service:
    """A transport that gives the answers in turn; an exception among them is raised."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, url, headers, payload, timeout):
        self.asked.append(payload)
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        content, reason = answer if isinstance(answer, tuple) else (answer, "stop")
        return {"choices": [{"message": {"content": content}, "finish_reason": reason}], "usage": {"n": 1}}


def made(service, **settings):
    waits, told = [], []
    settings = client.ServiceSettings(api_key="k", **settings)
    return client.ServiceClient(settings, service, told.append, waits.append), waits, told


def test_an_answer_is_repaired_and_asked_for_again():
    service = Service("no json", '{"a": [1, {"b": "x')
    c, waits, told = made(service)
    assert c.chat_json("s", "u", "{}") == {"a": [1, {"b": "x"}]}
    assert service.asked[0]["messages"] == [{"role": "system", "content": "s\n\nShape of the JSON object:\n{}"}, {"role": "user", "content": "u"}]
    assert service.asked[1]["messages"][1]["content"].startswith("u\n\n") and service.asked[1]["messages"][1]["content"].endswith("\nno json")
    assert waits == [1] and [t["status"] for t in told] == ["malformed", "success"] and told[0]["content"] == "no json"


def test_attempts_end_with_a_shorter_text():
    text = "x" * 5000
    service = Service(('{"a": 1}', "length"), TimeoutError("late"), OSError("down"))
    c, waits, told = made(service)
    with pytest.raises(client.ServiceError, match="3 attempts") as e:
        c.chat_json("s", f"Title: t\nText:\n{text}")
    assert [a["status"] for a in e.value.attempts] == ["truncated", "timeout", "request"] and waits == [1, 2, 4]
    assert service.asked[2]["messages"][1]["content"] == "Title: t\nText:\n" + "x" * 2500
    assert client.shortened("y" * 1500) == "y" * 1000 and client.shortened("y" * 9000) == "y" * 4500
    with pytest.raises(client.ServiceError):
        made(Service("bad"), retries=1)[0].chat_json("s", "u")


def test_settings_come_from_the_environment():
    told = client.read_dotenv("# note\nOPENROUTER_MODEL = \"m/x\"\nOPENROUTER_RETRIES='5'\nbroken\nOPENROUTER_REPAIR_JSON=False\nOPENROUTER_WORKERS=0\nOPENROUTER_TEMPERATURE=0.5\nOPENROUTER_API_KEY=s=1")
    s = client.ServiceSettings.from_environment(told)
    assert (s.model, s.retries, s.repair_json, s.workers, s.temperature, s.api_key) == ("m/x", 5, False, 1, 0.5, "s=1")
    with pytest.raises(RuntimeError):
        client.ServiceClient(client.ServiceSettings())


@pytest.mark.parametrize("broken, whole", [('{"a": 1,', '{"a": 1}'), ('{"a": [1, "b\\"', '{"a": [1, "b\\""]}'), ('{"a": {"b":', '{"a": {"b"}}'), ('{"a]": "}"', '{"a]": "}"}'), ("{}", "{}")])
def test_truncated_json(broken, whole):
    assert close_truncated(broken) == whole


def test_objects_are_found():
    assert parse_object('```json\n{"a": 1}\n```') == {"a": 1} and parse_object('so: {"a": {"b": 2}} ok') == {"a": {"b": 2}}
    for bad in ("[1]", '{"a": ]', "none"):
        with pytest.raises(ValueError):
            parse_object(bad)


class Extractor:
    """Finds one relation in each text; texts with ``bad`` fail."""

    def chat_json(self, system, user, schema_hint=None):
        if "bad" in user:
            raise ValueError("no")
        name = user.split("\nText:\n")[1].split()[0]
        return {"entities": [], "relationships": [{"source": name, "target": "Town", "relation": "uses", "description": user[-20:]}]}


class Silent:
    def chat_json(self, system, user, schema_hint=None):
        raise TimeoutError("nobody there")


def test_extraction_is_kept_and_used_again(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "Mill makes things"), ("d2", "bad luck here"), ("d3", "Port takes things")], "id string, text string")
    first = Extraction(Extractor(), str(tmp_path))
    index = build_index(docs, how=first, with_communities=False)
    assert first.stats == {"successful_units": 2, "cached_units": 0, "failed_units": 1}
    assert {(e.source, e.target, e.relation) for e in index.edges.collect()} == {("Mill", "Town", "uses"), ("Port", "Town", "uses")}
    again = Extraction(Silent(), str(tmp_path))
    assert build_index(docs, how=again, with_communities=False).edges.count() == 2
    assert again.stats == {"successful_units": 2, "cached_units": 2, "failed_units": 1}
    assert ["nobody there" in r.error for r in spark.read.parquet(f"{tmp_path}/llm_errors").collect()] == [True]
    with pytest.raises(RuntimeError, match="1 units failed"):
        build_index(docs, how=Extraction(Extractor(), continue_on_error=False), with_communities=False)


def test_finalize_enriched(spark, tmp_path):
    docs = [("d1", "Old Mill depends on River Town. Old Mill causes River Town. River Town uses Sea Port."), ("d2", "OLD MILL blocks Sea Port.")]
    index = build_index(spark.createDataFrame(docs, "id string, text string"))
    full = enrich_index(index, enrichment.RuleClient())
    edges, entities = full.edges.collect(), {e.title: e for e in full.entities.collect()}
    ends = [x for e in edges for x in (e.source, e.target)]
    assert "OLD MILL" not in ends and "OLD MILL" in entities["Old Mill"].aliases
    assert any(e.evidence_type == "inferred" for e in edges) and all(e.ord is not None for e in edges)
    for e in edges:
        assert e.combined_degree == ends.count(e.source) + ends.count(e.target) and 0 <= e.reliability <= 1 and e.semantic_summary == e.semantic_summary.strip()
    assert all(n.degree == ends.count(n.title) for n in entities.values())
    assert {x for c in full.communities.collect() for x in c.entity_ids} == set(entities) and full.reports.count() == full.communities.count()
    index.save(f"{tmp_path}/ix")
    counts = cli.run(spark, ["enrich", "--index", f"{tmp_path}/ix", "--output", f"{tmp_path}/rich", "--offline", "--steps", "summaries"])
    assert counts["edges"] == index.edges.count() and Index.load(spark, f"{tmp_path}/rich").edges.where("semantic_summary = ''").count() == 0
    assert json.loads((tmp_path / "rich" / "manifest.json").read_text())["enriched"]
    with pytest.raises(FileNotFoundError):
        Index.load(spark, f"{tmp_path}/none")


def test_weights_of_the_hybrid_mode(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"bm25": 0.1, "lexical": 1}')
    (tmp_path / "s.json").write_text('{"top_k": 3}')
    assert hybrid_weights(spark, str(tmp_path / "w.json")) == HYBRID | {"bm25": 0.1, "lexical": 1.0}
    assert hybrid_weights(spark, str(tmp_path / "s.json")) == HYBRID == hybrid_weights(spark, None)


def test_input_hash_follows_relative_paths(spark, tmp_path):
    for root in ("a", "b", "c"):
        (tmp_path / root / "sub").mkdir(parents=True)
        (tmp_path / root / "sub" / ("y.txt" if root == "c" else "x.txt")).write_text("same")
    a, b, c = (sinks.input_hash(spark, str(tmp_path / root)) for root in "abc")
    assert a == b != c and sinks.input_hash(spark, str(tmp_path / "a" / "sub" / "x.txt")) == sinks.input_hash(spark, str(tmp_path / "b" / "sub" / "x.txt"))


def test_pictures(spark):
    nodes = [{"title": f"n{k} <x>", "degree": k % 5} for k in range(40)]
    edges = [{"source": f"n{k} <x>", "target": f"n{(7 * k) % 40} <x>", "relation": "uses", "reliability": k / 40} for k in range(40)]
    data = sinks.graph_png(nodes, edges, 200)
    assert data.startswith(b"\x89PNG\r\n\x1a\n") and data.endswith(b"IEND\xaeB`\x82")
    page = sinks.graph_html(nodes, edges)
    assert page.count("<circle") == 40 and "<x>" not in page.replace("n0 &lt;x&gt;", "")
    assert sinks.graph_html([], []) and sinks.graph_png([], [], 10)


def test_dead_ends_of_inference_keep_their_order(spark):
    docs = spark.createDataFrame([("d1", "Old Mill causes River Town. River Town uses Sea Port.")], "id string, text string")
    index = build_index(docs, with_communities=False)
    edges = enrichment.enrich_graph(index.entities, index.edges, enrichment.RuleClient(), ["infer"])[1]
    told, new = edges.where("evidence_type <> 'inferred'"), edges.where("evidence_type = 'inferred'")
    assert new.count() == 1 and new.first().ord > told.agg(F.max("ord")).first()[0]
