"""What building an index and ranked lists writes, and the texts of bodies."""

from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.plans import index as plans
from tessera.plans import iterative, ranking
from tessera.plans.config import Settings


def watched(monkeypatch, module):
    names, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name, *more: (names.append((name, df.columns)), write(df, name, *more))[1])
    return names


DOCS = [(1, "Old Mill", "Old Mill causes New Town. " * 9), (2, "blank", " \n"), (3, None, "few words"), (None, "nameless", "no id here")]


def test_lists_without_dense_and_enrichment_write_no_graph_and_no_tokens(spark, monkeypatch):
    built, ranked = watched(monkeypatch, plans), watched(monkeypatch, ranking)
    docs = spark.createDataFrame(DOCS, "id long, title string, text string")
    index = plans.build_index(docs, 10, 2, with_communities=False, keep_graph=False)
    assert [n for n, _ in built] == ["units"] and "token_count" not in built[0][1]
    assert index.units.where(F.col("token_count") != t.estimate_tokens(F.col("text"))).count() == 0 < index.units.count()
    queries = spark.createDataFrame([(1, "old mill words")], "qid int, text string")
    lists = ranking.ranked_lists(index, queries, Settings(use_dense=False, use_enrichment=False))
    assert lists.where("field = 'body' and score > 0").count() == 2
    assert "fields" not in [n for n, _ in ranked]
    ranked.clear()
    ranking.ranked_lists(index, queries, Settings(use_enrichment=False))
    assert "fields" in [n for n, _ in ranked]


def test_bodies_of_documents_with_and_without_units(spark, monkeypatch):
    docs = plans.with_document_fields(spark.createDataFrame(DOCS, "id long, title string, text string"))
    units = spark.createDataFrame([(1, 1, "second"), (1, 0, "first"), (None, 0, "lost")], "document_id long, position int, text string")
    written = watched(monkeypatch, ranking)
    got = {x.id: x.text for x in ranking.body_text(plans.Index(docs, units, docs, docs)).collect()}
    assert got == {1: "Old Mill. first second", 2: "blank.  \n", 3: ". few words", None: "nameless. no id here"}
    assert written == [("bare", ["id"])]


def test_an_iterative_retrieval_makes_tokens_once(spark, monkeypatch):
    ranked, outer = watched(monkeypatch, ranking), watched(monkeypatch, iterative)
    docs = spark.createDataFrame([(i, f"t{i}", f"Old Mill causes New Town. Big River prevents Old Mill. word{i}") for i in range(4)], "id long, title string, text string")
    index = plans.build_index(docs, with_communities=False)
    queries = spark.createDataFrame([(1, "what does the old mill cause")], "qid int, text string")
    config = Settings(use_dense=False, use_enrichment=False)
    assert iterative.retrieve_iterative(index, queries, config).count() == 4
    assert [n for n, _ in outer].count("fields") == 1 and "fields" not in [n for n, _ in ranked]
    assert [n for n, _ in ranked].count("bare") == 1
    wanted = spark.createDataFrame([(1, 0, "word0"), (1, 1, "word0"), (1, 2, "New Town")], "qid int, id long, entity string")
    own = {tuple(r) for r in iterative.mentions(index, wanted, ranking.field_tokens(index, config)).collect()}
    assert own == {tuple(r) for r in iterative.mentions(index, wanted).collect()} == {(1, 0, "word0"), (1, 2, "New Town")}
