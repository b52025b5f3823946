"""The jobs: on growing input, run again, run by the command line."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import graph_stream, question_report
from tessera.operators import calibration, chunking, extraction

SENTENCES = (
    "Old Mill depends on River Town.", "River Town uses Sea Port.", "OLD MILL depends on River Town daily.", "Sea Port is part of North Coast.", "Old Mill causes River Town trouble.",
    "nothing of note happened.", "North Coast blocks Old Mill.", "Grand Hall meets Sea Port.",
)


def texts(first, n):
    return [(first + i, " ".join(SENTENCES[(first * 3 + i * k) % len(SENTENCES)] for k in range(1, 6)), "x") for i in range(n)] + [(first + n, None, "y"), (first + n + 1, "", "y")]


def batch_edges(spark, path):
    docs = spark.read.parquet(path).select(F.col("doc_id").alias("id"), "text")
    rows = extraction.relation_rows(chunking.chunk_documents(docs, 600, 100))
    return calibration.calibrate_edges(extraction.with_combined_degree(extraction.merge_edges(rows)))


def same(a, b):
    names = sorted(c for c in a.columns if c != "ord")
    assert sorted(b.columns) == sorted(a.columns)
    key = lambda df: sorted(repr(tuple(r)) for r in df.select(*names).collect())
    assert key(a) == key(b)


def files(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_graph_grows_with_its_collection(spark, tmp_path):
    docs, out, checkpoint = f"{tmp_path}/docs", f"{tmp_path}/graph", f"{tmp_path}/checkpoint"
    schema, before = "doc_id long, text string, extra string", spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.createDataFrame(texts(0, 40), schema).repartition(3).write.parquet(docs)
    first = graph_stream.run(spark, docs, out, checkpoint)
    assert first["documents"] == 42 and first["batches"] == 1
    same(spark.read.parquet(f"{out}/edges"), batch_edges(spark, docs))
    # without new files nothing is read, and what is there stays
    parts = files(f"{out}/parts")
    again = graph_stream.run(spark, docs, out, checkpoint)
    assert (again["documents"], again["batches"], again["edges"]) == (0, 0, first["edges"]) and files(f"{out}/parts") == parts
    same(spark.read.parquet(f"{out}/edges"), batch_edges(spark, docs))
    # new files, one a batch; documents that repeat earlier edges and come before others by id
    spark.createDataFrame(texts(-50, 30), schema).repartition(2).write.mode("append").parquet(docs)
    (tmp_path / "config.json").write_text('{"max_files": 1}')
    more = graph_stream.run(spark, docs, out, checkpoint, f"{tmp_path}/config.json")
    assert more["documents"] == 32 and more["batches"] == 2 and files(f"{out}/parts")[: len(parts)] == parts
    same(spark.read.parquet(f"{out}/edges"), batch_edges(spark, docs))
    # a failure after the last batch was written, before it was recorded: it runs again, over its own partition
    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    replayed = graph_stream.run(spark, docs, out, checkpoint)
    assert replayed["batches"] == 1 and spark.read.parquet(f"{out}/parts").select("batch").distinct().count() == 3
    same(spark.read.parquet(f"{out}/edges"), batch_edges(spark, docs))
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_graph_of_a_collection_without_names(spark, tmp_path):
    spark.createDataFrame([(1, "no names here"), (2, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    got = graph_stream.run(spark, f"{tmp_path}/docs", f"{tmp_path}/graph", f"{tmp_path}/checkpoint")
    assert got == {"batches": 1, "parts": 0, "documents": 2, "edges": 0}


def test_question_report(spark, tmp_path):
    docs = [(1, "the old mill by the river grinds corn all day"), (2, "a mill"), (3, "old mill by the river grinds"), (4, None), (5, "")]
    asked = [(10, "old mill by the river grinds"), (11, "sea port of the north coast"), (12, "the"), (13, "mill corn grinds quickly here today")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/q")
    (tmp_path / "c.json").write_text('{"top_k": 2}')
    counts = question_report.run(spark, f"{tmp_path}/q", f"{tmp_path}/d", f"{tmp_path}/o", f"{tmp_path}/c.json")
    assert counts == {"questions": 4, "documents": 5, "rows": 4}
    rows = {r.qid: r for r in spark.read.parquet(f"{tmp_path}/o/report").collect()}
    assert (rows[10].status, rows[10].n_evidence, rows[10].n_hits, rows[10].first_hit, rows[10].recall_at_k, rows[10].mrr) == ("evaluated", 2, 2, 1, 1.0, 1.0)
    assert (rows[11].status, rows[11].found, rows[11].best_score, rows[11].recall_at_k) == ("null", "", None, None)
    assert rows[12].status == "evaluated" and rows[12].found == "" and rows[12].recall_at_k == 0.0 and rows[13].found.startswith("1")
    first = sorted(map(repr, rows.values()))
    assert question_report.run(spark, f"{tmp_path}/q", f"{tmp_path}/d", f"{tmp_path}/o", f"{tmp_path}/c.json") == counts
    assert sorted(map(repr, spark.read.parquet(f"{tmp_path}/o/report").collect())) == first
    assert sorted(os.listdir(f"{tmp_path}/o/report"))[-2:] == ["status=evaluated", "status=null"]
    assert {r.status: r.questions for r in spark.read.parquet(f"{tmp_path}/o/summary").collect()} == {"evaluated": 2, "null": 2}
    (tmp_path / "bad.json").write_text('{"topk": 2}')
    with pytest.raises(ValueError, match="topk"):
        question_report.run(spark, f"{tmp_path}/q", f"{tmp_path}/d", f"{tmp_path}/o", f"{tmp_path}/bad.json")


def test_command_line(spark, tmp_path):
    spark.createDataFrame(texts(0, 10), "doc_id long, text string, extra string").write.parquet(f"{tmp_path}/docs")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    command = [sys.executable, "-m", "jobs.graph_stream", "--documents", f"{tmp_path}/docs", "--output", f"{tmp_path}/g", "--checkpoint", f"{tmp_path}/c", "--config", f"{root}/jobs/graph_stream.json"]
    done = subprocess.run(command, cwd=root, capture_output=True, text=True, timeout=240, env={**os.environ, "SPARK_LOCAL_IP": "127.0.0.1"}, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout.strip().splitlines()[-1])["documents"] == 12 and "read 12 new documents" in done.stderr
    same(spark.read.parquet(f"{tmp_path}/g/edges"), batch_edges(spark, f"{tmp_path}/docs"))
