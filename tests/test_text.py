"""Text expressions against plain Python."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import rules as r
from tessera.functions import text as t
from tessera.functions.jsonrepair import parse_object

SAMPLES = [
    "The Quick-Brown fox's den. It RAN!  Really?\nNew line\n\n  last ", "", "   ", "a", "Ärger in Öl: Straße_1 и Москва Река", "ÉCOLE Paris Nord Est Ouest Sud Extra", "don't stop-me now... ok? yes!",
    "Der Große ẞ ΣΑΣ", "Alpha Beta depends on Gamma. Delta causes Epsilon; Zeta Eta", None,
]


def column(spark, expression, samples=SAMPLES):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    return [x.v for x in df.select("i", expression(F.col("s")).alias("v")).orderBy("i").collect()]


def py_tokens(s):
    return [x.lower() for x in re.findall(r"[\w'-]+", s or "")]


def py_content(s):
    return [x for x in py_tokens(s) if x not in t.STOPWORDS and len(x) > 1]


def test_tokens(spark):
    assert column(spark, t.tokens) == [py_tokens(s) for s in SAMPLES]
    assert column(spark, t.content_tokens) == [py_content(s) for s in SAMPLES]
    assert column(spark, t.estimate_tokens) == [max(1, math.ceil(1.25 * len(py_tokens(s)))) for s in SAMPLES]
    assert len(t.STOPWORDS) == 57


def test_sentences_and_truncation(spark):
    want = [[p.strip() for p in re.split(r"(?<=[.!?])\s+|\n+", s or "") if p.strip()] for s in SAMPLES]
    assert column(spark, t.sentences) == want
    assert column(spark, lambda c: t.truncate_to_tokens(c, 4)) == [" ".join((s or "").split()[:3]) for s in SAMPLES]
    assert set(column(spark, lambda c: t.truncate_to_tokens(c, 0))) == {""}
    assert column(spark, lambda c: t.truncate_to_tokens(c, 1))[0] == "The"


def test_names(spark):
    pattern = re.compile(r"\b[A-ZА-ЯЁ][\w-]*(?:\s+[A-ZА-ЯЁ][\w-]*){0,4}\b")
    want = [list(dict.fromkeys(x.strip() for x in pattern.findall(s or "") if len(x.strip()) > 1)) for s in SAMPLES]
    assert column(spark, t.names) == want


def test_ids_and_keys(spark):
    got = column(spark, lambda c: t.stable_id("doc", c, F.lit(7)))
    assert got == ["doc_" + hashlib.sha1(f"{s or ''}\x1f7".encode()).hexdigest()[:16] for s in SAMPLES]
    assert column(spark, t.entity_key) == [re.sub(r"[^\w]+", "", (s or "").casefold()) for s in SAMPLES]


def test_lexical_similarity(spark):
    def cosine(a, b):
        x, y = Counter(py_content(a)), Counter(py_content(b))
        norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y[k] for k, v in x.items()) / norm if norm else 0.0

    other = "fox fox den москва paris stop-me"
    assert column(spark, lambda c: t.lexical_similarity(c, F.lit(other))) == pytest.approx([cosine(s, other) for s in SAMPLES])


@pytest.mark.parametrize(
    "sentence, relation",
    [
        ("A causes B", "causes"), ("A leads to B, which blocks C", "causes"), ("It blocks C", "prevents"), ("X requires Y", "depends_on"), ("X is part of Y", "part_of"),
        ("based in Rome", "located_in"), ("Related To it", "associated_with"), ("Сон мешает работе", "prevents"), ("causeway", "co_occurs"), (None, "co_occurs"),
    ],
)
def test_relations(spark, sentence, relation):
    got = column(spark, r.relation_of, [sentence])[0]
    assert (got["name"], got["kind"]) == (relation, "implicit" if relation == "co_occurs" else "explicit")


def test_normalize_relation(spark):
    names = ["Competes Against", "related_to", "co_occurs", "--Located in--", "hosts", "", None, "HAS PLAYER", "invented"]
    got = [(x["relation"], x["ontology_ok"]) for x in column(spark, r.normalize_relation, names)]
    bad = ("associated_with", False)
    assert got == [("competes_with", True), ("associated_with", True), bad, ("located_in", True), ("hosts", True), bad, bad, ("plays_for", True), bad]


def test_query_rules(spark):
    asked = ["Why did it fail?", "Where is it", "an overview of it", "because of what?", "who won", "Почему так", None]
    assert column(spark, r.intent, asked) == ["causal", "factual", "global", "causal", "exploratory", "causal", "exploratory"]
    hints = column(spark, r.relation_hints, ["Who is the spouse of the founder of Acme?", "city", None])
    assert hints == [["spouse partner wife husband", "founder founded co-founder", "spouse founder acme"], ["located location city country province", "city"], []]
    clauses = column(spark, r.decompose, ["Who founded the old mill company, and where did the first owner live before; ok", "short query", "  ", None])
    assert clauses[0] == ["Who founded the old mill company, and where did the first owner live before; ok", "Who founded the old mill company", "where did the first owner live before"]
    assert clauses[1:] == [["short query"], [], []]
    many = "; ".join(f"alpha{k} beta{k} gamma{k} delta{k}" for k in range(9))
    assert [len(column(spark, lambda c, m=m: r.decompose(c, m), [many])[0]) for m in (1, 2, 4)] == [2, 2, 4]


def test_bridge_factor(spark):
    rows = [(["spouse"], "a person", 2, 1.9), (["spouse"], "thing", 1, 0.45), (["spouse"], "city", 2, 0.55), (["company"], "company", 2, 1.7), (["company"], "person", 2, 0.55), (["where"], "place", 1, 1.5), (["spouse", "company"], "agency", 2, 1.7), ([], "person", 1, 1.0)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, q array<string>, k string, n int, want double")
    assert all(x.got == x.want for x in df.withColumn("got", r.bridge_factor(F.col("q"), F.col("k"), F.col("n"))).collect())


@pytest.mark.parametrize(
    "content, value",
    [('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}), ('Sure: {"a": "}"} done', {"a": "}"}), ('{"a": [1, {"b": "x', {"a": [1, {"b": "x"}]}), ('{"a": 1,', {"a": 1})],
)
def test_json_repair(content, value):
    assert parse_object(content) == value


@pytest.mark.parametrize("content", ['{"a": 1 "b": 2}', "[1, 2]", "nothing", '{"a": ]}'])
def test_json_that_stays_broken(content):
    with pytest.raises(ValueError):
        parse_object(content)


def test_truncated_json_is_an_error_without_repair():
    with pytest.raises(ValueError):
        parse_object('{"a": [1', repair=False)
