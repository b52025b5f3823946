"""How often the queries read their texts, and what they write on the way."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.operators import calibration, chunking, graph, scoring
from tessera.plans import context
from tessera.plans import index as index_plans
from tessera.storage import materialize

TEXT = "Alpha Works uses Beta Works. Beta Works causes Gamma Hall.\nGamma Hall is part of Delta Town"


def tables(spark, folder):
    docs = [(i, TEXT if i % 3 else f"Nothing number {i}", "en", "web") for i in range(9)] + [(9, None, None, None), (10, " \n", "en", "web")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "Where is Gamma Hall"), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def names_written(monkeypatch):
    told = []
    monkeypatch.setattr(index_plans, "materialize", lambda df, name, keep=False, f=index_plans.materialize: told.append(name) or f(df, name, keep))
    return told


def test_words_of_a_document_are_found_once(spark, tmp_path):
    docs = spark.read.parquet(f"{tables(spark, tmp_path)}/documents.parquet").withColumnRenamed("doc_id", "id")
    units = chunking.chunk_documents(docs)
    assert plan(units).count("(?U)\\S+") == 1
    assert {r["document_id"] for r in units.collect()} == set(range(9))


def test_graph_queries_read_the_texts_once(spark, tmp_path):
    sf = tables(spark, tmp_path)
    for name in ("graph_entities", "graph_components"):
        found = queries.QUERIES[name](spark, sf)
        assert "documents.parquet" not in " ".join(found.inputFiles()), name
        assert found.count() == 4, name


def test_entities_and_edges_need_no_table_of_units(spark, tmp_path, monkeypatch):
    told, sf = names_written(monkeypatch), tables(spark, tmp_path)
    for name in ("enrich_resolved_entities", "enrich_resolve_aliases"):
        told.clear()
        queries.QUERIES[name](spark, sf)
        assert told == ["rows", "edges", "entities"], name


def test_metadata_needs_no_graph(spark, tmp_path, monkeypatch):
    told, sf = names_written(monkeypatch), tables(spark, tmp_path)
    assert queries.QUERIES["rank_metadata_match"](spark, sf).where("qid = 1").count() == 6
    assert told == []


def test_two_hop_paths_write_narrow_edges(spark, tmp_path):
    lines = [(1, 1, 1, "R"), (2, 1, 1, "A"), (3, 2, 1, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "Brand#1"), (2, "Brand#2")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    found = queries.QUERIES["graph_two_hop_paths"](spark, str(tmp_path))
    assert spark.read.parquet(*found.inputFiles()).columns == ["id", "source", "target"]
    assert sorted((r["source"], r["via"], r["target"]) for r in found.collect()) == [("s1", "p1", "bBrand#1"), ("s1", "p1", "bBrand#1"), ("s2", "p1", "bBrand#1")]


def shuffle_files(spark):
    return {x for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_is_written(spark):
    before = shuffle_files(spark)
    assert materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts").count() == 7
    until = time.time() + 20
    while time.time() < until and any(x.endswith(".data") for x in shuffle_files(spark) - before):
        time.sleep(0.2)
    left = shuffle_files(spark) - before
    assert len([x for x in left if x.endswith(".data")]) <= 1, left  # that of the last count


def test_edges_are_dealt_once_for_their_pairs(spark):
    edges = spark.createDataFrame([("e", "A", "B", "uses", "A uses B", "table", 0.8, True, "ok", ["d"], 2)], "id string, source string, target string, relation string, evidence_text string, evidence_type string, llm_conf double, ontology_ok boolean, conflict_status string, source_docs array<string>, combined_degree long")
    plan = calibration.calibrate_edges(edges).select("id", "reliability")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(_s#" in x]
    assert len(dealt) == 1, plan


def test_seeds_of_one_id_follow_each_other(spark):
    rows = [("x", "A", "B", 0.9), ("x", "A", "B", 0.9), ("y", "B", "C", 0.5), ("z", "B", "D", 0.4)]
    edges = spark.createDataFrame(rows, "id string, source string, target string, reliability double").withColumn("ord", F.col("id"))
    assert [r["next_id"] for r in graph.inference_pairs(edges).orderBy("k").collect()] == ["y", "z", "y", "z"]


@pytest.mark.parametrize("name", ["calibrate_trade_edges", "graph_inference_pairs"])
def test_odd_trade_equals_its_sql(spark, tmp_path, name):
    lines = [(1, 1, 1, "R"), (2, 1, 1, "A"), (3, 1, 1, "N"), (4, 1, 1, "O"), (5, 2, 1, None), (6, None, 2, "R"), (7, 2, None, "R"), (8, 2, 3, "N"), (8, 2, 3, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "Brand#1"), (2, "Brand#2"), (3, None), (4, "s1")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for table in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    wanted = sorted(con.execute(queries.SQL[name]).fetchall())
    found = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert found == wanted and found


def test_only_texts_that_can_be_chosen_are_pairs(spark):
    words = [f"word{k}" for k in range(40)]
    r = random.Random(3)
    units = spark.createDataFrame([(f"u{k:03}", " ".join(r.choices(words, k=r.randrange(5, 30)))) for k in range(300)] + [(f"v{k}", "word1 word2 word3 word4 word5") for k in range(30)], "id string, text string")
    queries = spark.createDataFrame([(q, " ".join(r.choices(words, k=6))) for q in range(4)], "qid int, text string")
    own = units.withColumns({"useful_for": F.array().cast("array<string>"), "reliability": F.lit(0.7)})
    made = lambda lone, pool: context.scored(queries, own, "text_unit", context.Scale("hybrid"), F.lit(0.9), (0.65, 0.35), lone=lone)(pool)
    every, few = made(False, 10_000).collect(), {(x.qid, x.item): x for x in made(True, 3).collect()}
    terms = scoring.query_terms(queries, ["qid"])
    bm25 = {(x.qid, x.id): x.score for x in scoring.bm25(scoring.postings(units, ["id"]), scoring.corpus_stats(units, []), terms, ["qid"], [], ["id"]).collect()}
    near = {(x.qid, x.id): x.embedding for x in scoring.dense_scores(queries, units).collect()}
    assert len(every) == 4 * 330 and all(abs(x.utility - 0.65 * bm25.get((x.qid, x.item), 0.0) - 0.35 * near[x.qid, x.item]) < 1e-8 for x in every)
    key = lambda x: (-x.score, x.token_count, x.item)
    for x in every:
        better = sum(1 for y in every if y.qid == x.qid and y.token_count <= x.token_count and key(y) < key(x))
        assert better > 3 or few[x.qid, x.item].score == x.score
    assert len(few) < len(every) / 4


def test_parts_are_weighed_where_they_meet(spark, monkeypatch):
    r, words = random.Random(5), [f"word{k}" for k in range(15)]
    units = [(d, p, r.choices(words, k=r.randrange(1, 12))) for d in range(12) for p in range(1 + d % 4)] + [(20, p, ["word1", "word2"]) for p in range(3)]
    units = spark.createDataFrame(units, "id int, position int, tokens array<string>")
    queries = spark.createDataFrame([(q, " ".join(r.choices(words, k=5))) for q in range(5)] + [(9, "nothing")], "qid int, text string")
    terms = scoring.query_terms(queries, ["qid"])
    wanted = units.select("id").distinct().crossJoin(queries.select("qid"))
    scores = scoring.bm25(scoring.postings(units, ["id", "position"]), scoring.corpus_stats(units, ["id"]), terms.join(wanted, "qid"), ["qid", "id"], ["id"], ["position"]).collect()
    best = {}
    for x in scores:
        best[x.qid, x.id] = min(best.get((x.qid, x.id), (1, 0)), (-x.score, x.position))
    told = []
    monkeypatch.setattr(scoring, "materialize", lambda df, name, keep=False: told.append(name) or materialize(df, name, keep))
    wholes = units.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("position", "tokens"))).alias("units")).join(wanted.groupBy("id").agg(F.collect_set("qid").alias("qids")), "id")
    assert {(x.qid, x.id): x.position for x in scoring.best_parts(wholes, queries).collect()} == {k: v[1] for k, v in best.items()}
    assert told == []  # neither postings nor sums
