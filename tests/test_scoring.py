"""The best texts by bounds against the sums of all postings, and how little of them is added up."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import scoring


def made(n, seed, words=60, longest=25):
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, words + 1)
    told = [" ".join(f"w{int(i)}" for i in rng.choice(words, int(rng.integers(0, longest)), p=share / share.sum())) for _ in range(n)]
    return [told[int(rng.integers(0, i + 1))] if rng.random() < 0.3 else x for i, x in enumerate(told)]  # with copies


def every_sum(texts, queries, key, k, corpus):
    by = [corpus] if corpus else []
    scored = scoring.bm25(scoring.postings(texts, [*by, "id"]), scoring.corpus_stats(texts, by), scoring.query_terms(queries, key), key, by, ["id"])
    order = Window.partitionBy(*key, *by).orderBy(F.desc("score"), "id")
    return {tuple(r) for r in scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select(*key, *by, "id", "score").collect()}


@pytest.mark.parametrize("k, corpus, cells, products", [(3, None, 1 << 22, 1 << 22), (5, "field", 40, 60)])
def test_equals_the_sums_of_all_postings(spark, monkeypatch, k, corpus, cells, products):
    monkeypatch.setattr(scoring.Best, "CELLS", cells)
    monkeypatch.setattr(scoring.Best, "PRODUCTS", products)
    monkeypatch.setattr(scoring, "QUERIES_PER_PASS", 7)
    rows = [(f"t{i % 211:03d}" if i < 300 else f"x{i}", x, "ab"[i % 2]) for i, x in enumerate(made(420, 1))]
    rows = list({(r[0], r[2]): r for r in rows}.values()) if corpus else list({r[0]: r for r in rows}.values())
    texts = spark.createDataFrame(rows, "id string, text string, field string").repartition(5)
    queries = spark.createDataFrame([(i, i % 2, x) for i, x in enumerate(made(20, 2, 70, 9))], "qid int, sub int, text string")
    got = {tuple(r) for r in scoring.bm25_top_k(texts, queries, ["qid", "sub"], k, corpus).select("qid", "sub", *([corpus] if corpus else []), "id", "score").collect()}
    assert got == every_sum(texts, queries, ["qid", "sub"], k, corpus)


def test_texts_below_the_bound_are_not_scored():
    rng = np.random.default_rng(5)
    terms, texts, k = 200, 4000, 5
    query, term = np.repeat(np.arange(10), 12), np.concatenate([rng.choice(terms, 12, replace=False) for _ in range(10)])
    weight = rng.gamma(1.0, 2.0, 120)
    best, scored = scoring.Best(query, term, weight, 10, terms, k), 0
    whole = best._whole
    raw = np.zeros((10, texts))

    def counting(q, which, *rest):
        nonlocal scored
        scored += len(which)
        return whole(q, which, *rest)

    best._whole = counting
    for at in range(0, texts, 250):
        own = [np.sort(rng.choice(terms, 30, replace=False)) for _ in range(250)]
        text, found = np.repeat(np.arange(250), 30), np.concatenate(own)
        part = rng.uniform(0.2, 0.9, len(found))
        for q in range(10):
            w = np.zeros(terms)
            w[term[query == q]] = weight[query == q]
            raw[q, at : at + 250] = np.bincount(text, w[found] * part, 250)
        best.add(list(range(at, at + 250)), text, found, part)
    for q in range(10):
        order = sorted(range(texts), key=lambda i: (-raw[q, i], i))[:k]
        assert [i for _, i in best.found[q][:k]] == order and [-s for s, _ in best.found[q][:k]] == [raw[q, i] for i in order]
    assert scored < 0.5 * 10 * texts


def test_no_queries_no_texts_no_terms(spark):
    texts = spark.createDataFrame([("a", "one two"), ("b", None), ("c", "")], "id string, text string")
    queries = spark.createDataFrame([(1, "the"), (2, None), (3, "zzz one")], "qid int, text string")
    assert [(r.qid, r.id, r.score) for r in scoring.bm25_top_k(texts, queries, ["qid"]).collect()] == [(3, "a", 1.0)]
    assert scoring.bm25_top_k(texts, queries.limit(0), ["qid"]).count() == 0 == scoring.bm25_top_k(texts.limit(0), queries, ["qid"]).count()
    filled = scoring.filled_top_k(texts, queries, ["qid"], 2).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id, r.score) for r in filled] == [(1, "a", 0.0), (1, "b", 0.0), (2, "a", 0.0), (2, "b", 0.0), (3, "a", 1.0), (3, "b", 0.0)]


def test_the_nearest_in_bounded_memory(spark, monkeypatch):
    rng = np.random.default_rng(8)
    for k, texts, ids in ((1, 50, list(range(50))), (7, 3000, [f"t{i:05d}" for i in rng.permutation(3000)])):
        scores = np.round(np.maximum(0.0, rng.normal(size=(20, texts))), 1)  # many ties and zeros
        nearest = scoring.Nearest(20, k)
        for at in range(0, texts, 37):
            nearest.add(ids[at : at + 37], scores[:, at : at + 37])
            assert max(map(len, nearest.found)) <= k
        got = sorted(nearest.rows())
        assert got == sorted((q, ids[i], scores[q, i]) for q in range(20) for i in sorted(range(texts), key=lambda i: (-scores[q, i], ids[i]))[:k])
    monkeypatch.setattr(scoring, "TEXTS_AT_ONCE", 3)
    monkeypatch.setattr(scoring, "QUERIES_PER_PASS", 4)
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(made(60, 9))], "id long, text string").repartition(4)
    queries = spark.createDataFrame([(i, x) for i, x in enumerate(made(9, 10, 60, 9))], "qid long, text string")
    every = scoring.dense_scores(queries, texts).withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("embedding"), "id"))).where("n <= 5")
    assert {(r.qid, r.id, r.score) for r in scoring.dense_top_k(queries, texts, ["qid"], 5).collect()} == {(r.qid, r.id, r.embedding) for r in every.collect()}
