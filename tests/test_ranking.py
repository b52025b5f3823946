"""Scoring, ranking, context and iterative retrieval against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import scoring
from tessera.plans import context, iterative, ranking
from tessera.plans.config import DEFAULT_WEIGHTS, Settings
from tessera.plans.index import build_index

from .test_text import py_content


def bm25(query, texts):
    asked, docs = py_content(query), [py_content(x) for x in texts]
    mean = sum(map(len, docs)) / max(1, len(docs))
    df = Counter(w for d in docs for w in set(d))
    out = []
    for d in docs:
        tf, s = Counter(d), 0.0
        for w in asked:
            if tf[w]:
                s += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / max(1.0, mean)))
        out.append(s)
    top = max(out, default=0.0)
    return [round(s / top, 9) if top else 0.0 for s in out]


def corpus(seed=1, n=30):
    r = random.Random(seed)
    words = [f"word{k}" for k in range(60)] + ["Old Mill", "New Town", "causes", "the", "of"]
    return [(f"d{k:02}", " ".join(r.choice(words) for _ in range(r.randrange(1, 60))) + ".", f"title{k % 7} word{k}", f"src{k % 3}", "cat") for k in range(n)]


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(corpus(), "id string, text string, title string, source string, category string"), 20, 5)


@pytest.fixture(scope="module")
def queries(spark):
    asked = ["word1 word2 word3 word4 and word5 word6 word7 word8", "title3 src1", "nothing known", "word9 word9 the of", "Where is Old Mill; word10 word11 word12 word13"]
    return spark.createDataFrame(list(enumerate(asked)), "qid int, text string")


def test_bm25(spark):
    texts = [x[1] for x in corpus()] + ["", "the of"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for query in ("word1 word2 word2 word3", "the", "zzz", "word5"):
        q = spark.createDataFrame([(0, query)], "qid int, text string")
        found = scoring.bm25(scoring.postings(df, ["id"]), scoring.corpus_stats(df, []), scoring.query_terms(q, ["qid"]), ["qid"], [], ["id"])
        got = {x.id: x.score for x in found.collect()}
        assert [got.get(i, 0.0) for i in range(len(texts))] == pytest.approx(bm25(query, texts), abs=2e-9)


def test_hashed_embedding_and_dense_top_k(spark):
    v, none = scoring.hashed_embedder([["alpha", "beta", "alpha"], []])
    assert np.linalg.norm(v) == pytest.approx(1.0) and len(v) == 256 and not none.any()
    rows = [(x[0], x[1]) for x in corpus()] + [("z", "")]
    df = spark.createDataFrame(rows, "id string, text string")
    q = spark.createDataFrame([(0, "word1 word2 word3"), (1, "")], "qid int, text string")
    got = {}
    for x in scoring.dense_top_k(q, df, ["qid"], 5).collect():
        got.setdefault(x.qid, {})[x.id] = x.score
    vectors = {i: scoring.hashed_embedder([py_content(s)])[0] for i, s in rows}
    for qid, text in ((0, "word1 word2 word3"), (1, "")):
        asked = scoring.hashed_embedder([py_content(text)])[0]
        every = sorted((-round(max(0.0, float(asked @ v)), 9), i) for i, v in vectors.items())[:5]
        assert got[qid] == {i: -s for s, i in every}


def brute_first_stage(rows, units, text, config):
    """Scores of all documents by the definition: every list ranks every document."""
    clauses = [text] if "; " not in text and " and " not in text else [text] + [c for c in (p.strip(" ,.?") for p in text.replace("; ", " and ").split(" and ")) if len(py_content(c)) >= 4]
    ids = [r[0] for r in rows]
    fields = {"title": [r[2] for r in rows], "body": [f"{r[2]}. {' '.join(units[r[0]])}" for r in rows], "metadata": [f"{r[2]} {r[3]} {r[4]}" for r in rows]}
    rrf, feats, scores = Counter(), {i: Counter() for i in ids}, {i: [] for i in ids}
    for clause in clauses:
        lists = [(f, bm25(clause, texts)) for f, texts in fields.items()] + [("dense", [0.0] * len(ids))]
        best = Counter()
        for f, values in lists:
            for rank, k in enumerate(sorted(range(len(ids)), key=lambda k: (-values[k], ids[k]))[: config.candidate_k], 1):
                rrf[ids[k]] += {"title": 1.25, "body": 1.0, "metadata": 0.8, "dense": 0.75}[f] / (60 + rank)
                family = "bm25" if f in ("title", "body") else f
                feats[ids[k]][family] = max(feats[ids[k]][family], values[k])
                best[ids[k]] = max(best[ids[k]], values[k])
        for i in ids:
            scores[i].append(best[i])
    asked, out = set(py_content(text)), {}
    for i, r in zip(ids, rows, strict=True):
        meta = set(py_content(f"{r[2]} {r[3]} {r[4]}"))
        f = feats[i]
        out[i] = (
            0.45 * rrf[i] / max(rrf.values()) + 0.2 * f["bm25"] + 0.07 * sum(v >= 0.2 for v in scores[i]) / len(clauses) + 0.02 * max(f["metadata"], len(asked & meta) / len(meta))
        )
    return out, scores


@pytest.mark.parametrize("k", [5, 80])
def test_first_stage_ranks_all_documents(index, queries, k):
    config = Settings(candidate_k=k, use_dense=False, use_enrichment=False)
    units = {}
    for u in index.units.orderBy("position").collect():
        units.setdefault(u.document_id, []).append(u.text)
    got = {}
    for x in ranking.first_stage(index, queries, config, calibrated=False).collect():
        got.setdefault(x.qid, {})[x.id] = x
    for q in queries.collect():
        want, clauses = brute_first_stage(corpus(), units, q.text, config)
        best = sorted(want, key=lambda i: (-round(want[i], 9), i))[:k]
        assert {i: x.first_score for i, x in got[q.qid].items()} == pytest.approx({i: want[i] for i in best}, abs=1e-7)
        for i, x in got[q.qid].items():
            assert list(x.clause_scores) == pytest.approx(clauses[i], abs=1e-8)


def test_rank_documents(index, queries):
    config = Settings()
    ranked = ranking.rank_documents(index, queries, config).collect()
    by = {}
    for x in ranked:
        by.setdefault(x.qid, []).append(x)
    assert set(by) == {0, 1, 2, 3, 4} and all([x.rank for x in sorted(v, key=lambda x: x.rank)] == list(range(1, 11)) for v in by.values())
    for x in ranked:
        assert x.score == pytest.approx(sum(w * x[k] for k, w in DEFAULT_WEIGHTS.items()), abs=1e-6)
        assert len(x.snippet.split()) <= 144
    top = {q: max(v, key=lambda x: (x.score, x.id)).id for q, v in by.items()}
    assert all(min(v, key=lambda x: x.rank).id == top[q] for q, v in by.items())
    silent = {x.qid: x.abstained for x in ranking.abstains(ranking.rank_documents(index, queries, config), queries, config).collect()}
    assert set(silent) == set(by)


def test_coverage_order():
    score, ids = np.array([0.5, 0.5, 0.49, 0.1]), np.array(["a", "b", "c", "d"], object)
    clauses = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]])
    assert [ids[i] for i in ranking.coverage_order(score, ids, clauses, 4)] == ["b", "c", "a", "d"]
    assert ranking.coverage_order(score, ids, clauses, 1) == [1]


def test_a_reranker_is_stretched_per_query(index, queries):
    config = Settings(use_dense=False)
    longest = lambda asked, told: np.array([len(d) for d in told], float)
    got = ranking.rank_documents(index, queries, config, top_k=80, reranker=longest).collect()
    for qid in range(5):
        own = [x.reranker for x in got if x.qid == qid]
        assert max(own) == 1.0 and min(own) == 0.0
    with pytest.raises(RuntimeError):
        ranking.rank_documents(index, queries, Settings(strict_models=True)).collect()


def packed(spark, texts, budget):
    rows = [(0, f"d{k}", k, 0.5, a, b) for k, (a, b) in enumerate(texts)]
    df = spark.createDataFrame(rows, "qid int, id string, rank int, score double, title string, snippet string")
    return [(x.place, x.item, x.text, x.token_count) for x in context.pack_documents(df, budget).orderBy("place").collect()]


def test_pack_documents(spark):
    texts = [("one", "two three"), ("four", "five six seven"), ("eight", "nine")]
    assert packed(spark, texts, 8) == [(1, "d0", "one. two three", 4), (2, "d1", "four. five six", 4)]
    assert packed(spark, texts, 10)[1:] == [(2, "d1", "four. five six seven", 5)]
    assert packed(spark, [("a", "b")], 1) == [] and packed(spark, texts, 0) == []


def greedy(items, top_k, budget, limits):
    """The definition, item by item."""
    left, used, out, kinds = sorted(items, key=lambda c: (-c["score"], c["token_count"], c["item"])), set(), [], Counter()
    while len(out) < top_k:
        fits = [c for c in left if c["token_count"] <= budget and kinds[c["kind"]] < limits.get(c["kind"], top_k)]
        if not fits:
            return out
        best = max(fits, key=lambda c: (c["score"] * (1.0 - 0.65 * (len(set(c["source_ids"]) & used) / max(1, len(c["source_ids"])))), -left.index(c)))
        left.remove(best)
        out.append(best)
        used |= set(best["source_ids"])
        kinds[best["kind"]] += 1
        budget -= best["token_count"]
    return out


def test_choose():
    item = lambda i, s, n, kind="edge", sources=None: {"item": i, "kind": kind, "score": s, "token_count": n, "source_ids": sources or [i]}
    items = [item("a", 0.9, 5), item("b", 0.8, 5, sources=["a"]), item("c", 0.5, 5), item("r1", 0.4, 1, "report"), item("r2", 0.39, 1, "report"), item("big", 1.0, 99)]
    pick = lambda *more: [items[k]["item"] for k in context.choose(pd.DataFrame(items), *more)[0]]
    assert pick(10, 20, {"report": 1}) == ["a", "c", "r1", "b"]
    assert pick(2, 20, {}) == ["a", "c"]
    assert pick(3, 0, {}) == []


@pytest.mark.parametrize("seed", range(4))
def test_the_choice_is_that_among_all_items(spark, seed):
    """However many long items score better, a short one that alone fits is found, and sources that overlap are discounted."""
    r = random.Random(seed)
    items = [{"kind": "text_unit", "item": f"t{k}", "score": 0.9 - k / 10_000, "token_count": 30, "source_ids": [f"t{k}"]} for k in range(300)]
    items.append({"kind": "text_unit", "item": "short", "score": 0.1, "token_count": 3, "source_ids": ["short"]})
    items += [{"kind": "edge", "item": f"e{k}", "score": round(r.random(), 2), "token_count": r.choice([4, 9]), "source_ids": [f"e{k}"]} for k in range(60)]
    items += [{"kind": "report", "item": f"r{k}", "score": round(0.5 + r.random(), 2), "token_count": 6, "source_ids": [f"e{r.randrange(60)}" for _ in range(40)]} for k in range(5)]
    rows = [(7, c["kind"], c["item"], "text", 0.5, 0.5, c["score"], c["token_count"], c["source_ids"], []) for c in items]
    df = spark.createDataFrame(rows, f"qid int, {context.ITEM}")
    for top_k, budget in ((4, 33), (6, 60), (10, 1200)):
        got = context.select_under_budget(lambda pool: df.select(*context.SLIM), df.select(*context.DETAILS), top_k, budget, {"report": 2}).orderBy("place").collect()
        assert [x.item for x in got] == [c["item"] for c in greedy(items, top_k, budget, {"report": 2})]


@pytest.mark.parametrize("mode", ["heuristic", "embedding", "hybrid"])
def test_candidate_context(index, queries, mode):
    rows = context.candidate_context(index, queries, mode, top_k=8, budget=120).collect()
    by = {}
    for x in rows:
        by.setdefault(x.qid, []).append(x)
    for own in by.values():
        kinds = Counter(x.kind for x in own)
        assert len(own) <= 8 and sum(x.token_count for x in own) <= 120 and kinds["report"] <= 2 and kinds["path"] <= 3
        assert all(0 <= x.reliability <= 1 and 0 <= x.utility <= 1 for x in own)
    with pytest.raises(ValueError):
        context.candidate_context(index, queries, "nope")


def test_document_context_depends_on_the_budget_but_not_the_ranking(index, queries):
    ranked = ranking.rank_documents(index, queries, Settings(use_dense=False)).select("qid", "id", "rank", "score", "title", "snippet").cache()
    for budget in (1, 60, 400):
        rows = context.document_context(index, queries, ranked, budget).collect()
        for qid in range(5):
            own = sorted((x for x in rows if x.qid == qid), key=lambda x: x.place)
            assert sum(x.token_count for x in own) <= budget and [x.place for x in own] == list(range(1, len(own) + 1))
            documents = [x.item for x in own if x.kind == "document"]
            order = [x.id for x in ranked.where(F.col("qid") == qid).orderBy("rank").collect()]
            assert documents == [i for i in order if i in documents]
            if budget == 1:
                assert not own or all(x.token_count == 1 for x in own)


def test_merge_rankings_keeps_the_seed(spark):
    rows = [(0, 0, 1.0, "a", 1, 0.9)] + [(0, l, 1.5, i, r, 0.5) for l in (1, 2) for r, i in enumerate(["b", "c", "d"], 1)]
    df = spark.createDataFrame(rows, "qid int, list int, weight double, id string, rank int, score double")
    got = [(x.id, x.rank) for x in iterative.merge_rankings(df, 2, Settings()).orderBy("rank").collect()]
    assert got == [("b", 1), ("a", 2)]
    assert [x.id for x in iterative.merge_rankings(df, 4, Settings()).orderBy("rank").collect()] == ["b", "c", "d", "a"]


def test_iterative_finds_the_bridge_document(spark):
    docs = [
        ("d1", "Silver Comet was recorded by Mara Linden. The album sold well.", "Silver Comet"), ("d2", "Mara Linden is the wife of Tomas Berg who lives in Oslo.", "Mara Linden"),
        *[(f"x{k}", f"Filler number {k} about weather and rain and wind.", f"Filler {k}") for k in range(20)],
    ]
    index = build_index(spark.createDataFrame(docs, "id string, text string, title string"))
    asked = spark.createDataFrame([(0, "Who is the spouse of the performer of Silver Comet")], "qid int, text string")
    config = Settings(use_dense=False)
    ranked = ranking.rank_documents(index, asked, config).select("qid", "id", "rank", "score")
    bridges = iterative.bridge_entities(index, asked, ranked, config)
    named = [x.entity for x in bridges.orderBy("n").collect()]
    assert "Mara Linden" in named and "Silver Comet" not in named
    told = iterative.bridge_queries(asked, bridges).orderBy("n").collect()
    assert len(told) <= 8 and any(x.text == "Mara Linden spouse partner wife husband" for x in told)
    found = [x.id for x in iterative.retrieve_iterative(index, asked, config, top_k=3).orderBy("rank").collect()]
    assert len(found) == 3 and {"d1", "d2"} <= set(found)


def test_enrichment_fields_follow_their_flags(index):
    on = lambda **kw: {r.field for r in ranking.field_texts(index, Settings(**kw)).select("field").distinct().collect()}
    base = {"title", "body", "metadata"}
    assert on(use_enrichment=False) == base and on(use_enrichment=False, use_graph=True) == base | {"graph"}
    config = Settings()
    for signal, field in (("questions", "questions"), ("summaries", "summaries"), ("entities", "entities"), ("inferred_edges", "inferred_edges")):
        own = config.with_signals((signal,))
        assert {r.field for r in ranking.field_texts(index, own).select("field").distinct().collect()} == base | {field}
    assert not config.with_signals(()).use_enrichment


def test_config_from_file(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"top_k": 3, "unknown": 1, "weights": {"bm25": 1}}')
    config = Settings.load(str(path))
    assert config.top_k == 3 and config.weights == DEFAULT_WEIGHTS | {"bm25": 1.0} and Settings.load(None) == Settings()


def test_graph_expansion_rewards_shared_entities(spark):
    docs = [("d1", "Alpha Beta causes Gamma Delta. apples pears."), ("d2", "Gamma Delta depends on Omega Point."), ("d3", "Sigma Tau blocks Upsilon Phi."), *[(f"x{k}", "plums") for k in range(12)]]
    index = build_index(spark.createDataFrame(docs, "id string, text string"), with_communities=False)
    asked = spark.createDataFrame([(0, "apples pears")], "qid int, text string")
    config = Settings(use_dense=False, use_graph_expansion=True, graph_expansion_seed_k=1)
    got = {x.id: x.graph_expansion for x in ranking.first_stage(index, asked, config).collect()}
    assert got["d1"] == 1.0 and got["d2"] == 0.5 and got["d3"] == 0.0
