"""Metrics, splits and experiment runs."""

import math

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation
from tessera.plans import experiments
from tessera.plans.config import Settings
from tessera.plans.index import build_index

QA = "qid int, text string, answer string, evidence array<struct<url:string,title:string>>, question_type string"


def test_gold_and_status(spark):
    qa = spark.createDataFrame([(1, "q", "a", [("u1", None), (None, "Big STRASSE")], "x"), (2, "q", "a", [("gone", "")], "x"), (3, "q", "a", [], "x"), (4, "q", "a", None, "x"), (5, "q", "a", [(None, "t"), (None, "T")], None)], QA)
    docs = spark.createDataFrame([("d1", "u1", "one"), ("d2", "", "big straße"), ("d3", None, "T")], "id string, url string, title string")
    gold = evaluation.gold_documents(qa, docs)
    assert sorted(map(tuple, gold.collect())) == [(1, "d1"), (1, "d2"), (5, "d3")]
    status = {r.qid: (r.expected, r.found, r.status) for r in evaluation.evidence_status(qa, gold).collect()}
    assert status == {1: (1, 2, "evaluated"), 2: (1, 0, "incomplete"), 3: (0, 0, "null"), 4: (0, 0, "null"), 5: (1, 1, "evaluated")}
    errors = spark.createDataFrame([("d1", "timeout"), ("zz", "timeout")], "document_id string, error string")
    assert [r.document_id for r in evaluation.failed_evidence(errors, qa, docs).collect()] == ["d1"]
    cover = evaluation.evidence_coverage(qa, docs).first()
    assert (cover.complete_qa, cover.partial_qa, cover.total_qa) == (1, 2, 5)


def test_question_metrics(spark):
    places = spark.createDataFrame([(1, 1, ["x"]), (1, 2, ["a"]), (1, 3, ["b", "y"]), (2, 1, ["z"])], "qid int, rank int, ids array<string>")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "q"), (3, "p")], "qid int, id string")
    got = {r.qid: r for r in evaluation.question_metrics(places, gold, 10).collect()}
    one = got[1]
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert (one.recall_at_k, one.precision_at_k, one.mrr, one.all_evidence_success_at_k) == pytest.approx((2 / 3, 2 / 4, 0.5, 0.0))
    assert one.ndcg_at_k == pytest.approx((1 / math.log2(3) + 0.5) / ideal)
    assert (got[2].recall_at_k, got[2].mrr, got[3].recall_at_k, got[3].precision_at_k) == (0.0, 0.0, 0.0, 0.0)


def test_answers_and_packed_recall(spark):
    qa = spark.createDataFrame([(1, "q", "New  York", [], ""), (2, "q", "Yes", [], ""), (3, "q", "", [], ""), (4, "q", "Rome", [], "")], QA)
    context = spark.createDataFrame([(1, "in new york city", ["a"]), (2, "yes", ["b"]), (3, "x", ["b"]), (4, "paris", ["c"])], "qid int, text string, document_ids array<string>")
    got = {r.qid: (r.answer_evaluable, r.answer_hit) for r in evaluation.answer_hits(context, qa).collect()}
    assert got == {1: (True, 1.0), 2: (False, 0.0), 3: (True, 0.0), 4: (True, 0.0)}
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (4, "d")], "qid int, id string")
    assert {r.qid: r.packed_context_recall_at_k for r in evaluation.packed_recall(context, gold).collect()} == {1: 0.5, 4: 0.0}


def test_percentiles_and_delta(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 21)], "k string, v double")
    row = evaluation.percentiles(df, "v", ["k"]).first()
    assert (row.p50, row.p95) == (10.0, 19.0)
    two = spark.createDataFrame([("x", 0.5, 0.25), ("y", 0.75, 0.2)], "variant string, recall_at_k double, mrr double")
    assert {r.variant: (r.recall_at_k, r.mrr) for r in evaluation.delta(two, "variant", "x").collect()} == {"x": (0.0, 0.0), "y": (0.25, -0.05)}


def test_split_is_stratified_and_reproducible(spark):
    qa = spark.createDataFrame([(i, f"t{i % 2}", i % 3) for i in range(120)], "qid int, question_type string, evidence_count int")
    one, two = ({r.qid: r.split for r in evaluation.split(qa, seed).collect()} for seed in (42, 42))
    assert one == two and len(one) == 120 and one != {r.qid: r.split for r in evaluation.split(qa, 7).collect()}
    for kind in range(2):
        for n in range(3):
            own = [one[i] for i in range(120) if i % 2 == kind and i % 3 == n]
            assert (own.count("train"), own.count("dev"), own.count("test")) == (14, 3, 3)


def test_ablation_variants():
    variants = experiments.ablation_variants()
    assert len(variants) == 28 and len({v[0] for v in variants}) == 28
    assert [v[4] for v in variants].count("iterative") == 14 and variants[2][0] == "enriched_control_no_fields" and variants[13][0] == "all_enrichment_fields"
    assert len(experiments.tuning_configs()) == 6 and experiments.tuning_configs()[5].weights["enrichment"] == 0.10


def test_evaluation_runs(spark):
    docs = [("d1", "Silver Comet was recorded by Mara Linden in Oslo.", "Silver Comet"), ("d2", "Mara Linden lives near Lake Vettern.", "Mara Linden"), ("d3", "Rain and wind.", "Weather")]
    index = build_index(spark.createDataFrame(docs, "id string, text string, title string"))
    qa = spark.createDataFrame([(1, "who recorded silver comet", "Mara Linden", [("d1", None)], "bridge"), (2, "where does mara linden live", "Lake Vettern", [("d2", None), ("missing", None)], "bridge"), (3, "what is unknown", "x", [], None)], QA)
    config = Settings(use_dense=False)
    row = experiments.summary(experiments.evaluate(index, qa, "two_stage", config=config)).first()
    assert (row["count"], row.total_qa, row.skipped_null_queries, row.skipped_incomplete_evidence) == (1, 3, 1, 1)
    assert row.recall_at_k == row.all_evidence_success_at_k == row.answer_hit_rate == 1.0 and row.mrr == 1.0
    errors = spark.createDataFrame([("d1", "timeout")], "document_id string, error string")
    table = experiments.ablation(index, index, qa, errors, config, names={"calibrated_base_index", "questions"}).collect()
    assert {r.variant for r in table} == {"calibrated_base_index", "questions"} and not any(r.valid for r in table) and all(r.recall_at_k == 0.0 for r in table)
    trials = spark.createDataFrame([(0, 0.5, 0.5, 0.5, 2.0), (1, 0.5, 0.5, 0.5, 1.0), (2, 0.4, 0.9, 0.9, 0.1)], "trial int, all_evidence_success_at_k double, recall_at_k double, mrr double, seconds double")
    assert experiments.best_trial(trials).first().trial == 1
    with pytest.raises(ValueError):
        experiments.retrieve(index, qa.select("qid", "text"), "nope")
    assert F.lit(1) is not None


def test_containing(spark):
    docs = [(1, "aa bb cc dd ee ff gg hh"), (2, "xaa bb cc dd ee ff ggx"), (3, "aa  bb cc dd ee ff gg"), (4, "bb cc"), (5, None), (6, "")]
    passages = [(10, "aa bb cc dd ee ff gg"), (11, "bb cc dd"), (12, "bb cc"), (13, "d"), (14, "zz yy xx"), (15, ""), (16, None)]
    got = evaluation.containing(spark.createDataFrame(passages, "pid long, text string"), spark.createDataFrame(docs, "id long, text string"))
    want = [(p, i) for p, a in passages for i, b in docs if a and b and a in b]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("bins, few", [(4096, 100_000), (16, 3)])
def test_percentiles_by_refinement(spark, monkeypatch, bins, few):
    monkeypatch.setattr(evaluation, "BINS", bins)
    monkeypatch.setattr(evaluation, "FEW", few)
    r = random.Random(bins)
    inf, nan = float("inf"), float("nan")
    groups = {
        "a": [r.gauss(0, 1e3) for _ in range(200)], "b": [float(r.randrange(4)) for _ in range(90)], "c": [7.0] * 30, "d": [1.5], "e": [None, None], "f": [-inf, 1.0, 2.0, 3.0, inf, inf, 4.0, 5.0],
        "g": [nan, nan, 1.0, 2.0, 3.0, nan], "h": [10.0 ** r.uniform(-9, 9) for _ in range(60)] + [None], None: [3.0, 1.0, 2.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(3)
    got = {x.k: (x.p50, x.p95, x.p100) for x in evaluation.percentiles(df.where("k is not null"), "v", ["k"], (0.5, 0.95, 1.0)).collect()}
    for k, vs in groups.items():
        if k is not None:
            own = sorted((v for v in vs if v is not None), key=lambda v: (math.isnan(v), v))
            want = tuple(own[max(1, math.ceil(f * len(own))) - 1] if own else None for f in (0.5, 0.95, 1.0))
            assert repr(got[k]) == repr(want), k
    whole = [v for vs in groups.values() for v in vs if v is not None and not math.isnan(v)]
    (row,) = evaluation.percentiles(df.where("not isnan(v)"), "v", [], (0.5,)).collect()
    assert row.p50 == sorted(whole)[math.ceil(0.5 * len(whole)) - 1]
