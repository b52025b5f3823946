"""Which documents contain which passages, against plain Python."""

import random

import pyarrow as pa
import pytest

from tessera.operators import evaluation, scoring


def made(seed):
    r = random.Random(seed)
    part = lambda n: "".join(r.choice("ab é\n😀") for _ in range(n))
    texts = [part(r.randrange(0, 90)) for _ in range(60)] + ["", "ab" * 40, "é" * 50, "x" * 31 + "y" * 40]
    passages = [t[a : a + n] for t in texts for a in [r.randrange(0, 30)] for n in [r.choice([1, 2, 3, 5, 9, 17, 33, 70])]] + ["x" * 32, "y" * 33, "y" * 41, "é" * 40, "baba" * 10]
    return texts, [p for p in passages if p]


@pytest.mark.parametrize("seed, at_once", [(1, 1 << 18), (2, 64), (3, 1)])
def test_all_windows_and_pieces(monkeypatch, seed, at_once):
    monkeypatch.setattr(evaluation, "BYTES_AT_ONCE", at_once)
    texts, passages = made(seed)
    known = evaluation.Passages([p.encode() for p in passages])
    array = pa.array(["before", *texts, "after"]).slice(1, len(texts))
    assert known.inside(array) == [(i, p) for i, t in enumerate(texts) for p, x in enumerate(passages) if x in t]
    assert known.inside(array.slice(0, 0)) == [] == evaluation.Passages([]).inside(array)


def test_no_document_is_shuffled_and_rows_stay(spark, monkeypatch):
    """Rows that repeat or have no id are kept, as a join on the condition keeps them; more passages than a pass go in several."""
    monkeypatch.setattr(evaluation, "PASSAGES_PER_PASS", 3)
    docs = [(1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (None, "three four five six seven"), (3, None), (4, "")]
    asked = [(7, "two three four five six"), (8, "ve six"), (9, ""), (10, None), (11, "e"), (7, "ten"), (12, "two  three four five six")]
    d, p = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(asked, "pid int, text string")
    found = evaluation.containing(p, d)
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, found.collect()), key=key) == sorted([(pid, i) for pid, x in asked for i, t in docs if x and t and x in t], key=key)
    assert "Exchange" not in evaluation.containing(p, d.sparkSession.createDataFrame(docs, d.schema))._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_once_for_a_ranking(spark):
    """Terms, lengths and frequencies come from one pass, so that a text is split into tokens once."""
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = spark.createDataFrame([(i, f"word{i % 5} other{i}") for i in range(40)], "id long, text string")
    counted = texts.mapInArrow(counting, texts.schema)
    queries = spark.createDataFrame([(1, "word1 other7"), (2, "word3")], "qid int, text string")
    assert scoring.bm25_top_k(counted, queries, ["qid"], 3).count() == 6
    assert read.value == 40
