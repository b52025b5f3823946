"""Sources, sinks, streaming, command line and the registered queries."""

import json
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera import cli, sinks
from tessera.plans.index import Index, build_index
from tessera.queries import QUERIES, SQL
from tessera.sources import datasets, files
from tessera.streaming import extract

SF = "/root/testdata/sf0.001"


def test_ingest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("two\n\n words ")
    (tmp_path / "sub" / "b.html").write_text("<html><title>T</title><script>var x='</p>';</script><p>Hi <b>there</b></p></html>")
    (tmp_path / "c.csv").write_text("title,x\nOne,1\nTwo,\n", encoding="utf-8-sig")
    (tmp_path / "d.jsonl").write_text('{"text": "json text", "title": "J", "metadata": {"source": "wire", "url": "u9"}, "relationships": [{"source": "A", "target": "B"}]}\n"plain"\n{"body": " "}\n')
    (tmp_path / "e.json").write_text('{"content": "single"}')
    (tmp_path / "f.bin").write_bytes(b"\x00")
    rows = {r.text: r for r in files.ingest(spark, str(tmp_path)).collect()}
    assert set(rows) == {"two words", "T var x='</p>'; Hi there", "One 1", "Two", "json text", "plain", "single"}
    assert rows["json text"].title == "J" and rows["json text"].source == "wire" and rows["json text"].url == "u9" and rows["json text"].relationships[0].target == "B"
    assert rows["two words"].title == "a" and re.fullmatch("doc_[0-9a-f]{16}", rows["plain"].id) and rows["One 1"].title == "One"
    (tmp_path / "g.pdf").write_bytes(b"%PDF")
    with pytest.raises(Exception, match="pypdf"):
        files.ingest(spark, str(tmp_path)).collect()


def test_json_lines_are_read_in_splits(spark, tmp_path):
    (tmp_path / "sub d").mkdir()
    lines = [json.dumps({"text": f"line {i} " + "x" * (i % 90), "title": f"t{i}"}) for i in range(3000)]
    for k in range(0, 3000, 7):
        lines[k] += "\n" + " " * (k % 3)  # blank lines count for nothing
    (tmp_path / "sub d" / "a+b é.JSONL").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('"one"\n[1]\n{"body": "three"}')
    (tmp_path / "c.jsonlx").write_text("no json")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = files.read_files(spark, str(tmp_path))
        got = df.collect()
        splits = spark.read.text(str(tmp_path / "sub d")).select("_metadata.file_block_start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert splits > 5
    big = sorted((r.row, r.text.split()[1], r.path) for r in got if r.path.endswith("JSONL"))
    assert [(a, int(b)) for a, b, _ in big] == [(i, i) for i in range(3000)] and {p for _, _, p in big} == {f"file:{tmp_path}/sub d/a+b é.JSONL"}
    assert sorted((r.row, r.text) for r in got if r.path.endswith("b.jsonl")) == [(0, "one"), (2, "three")] and len(got) == 3002
    whole = {r.path: r.text for r in files.read_files(spark, str(tmp_path / "b.jsonl")).collect()}
    assert set(whole) == {f"file:{tmp_path}/b.jsonl"}


def test_texts_that_begin_alike_are_two_documents(spark):
    rows = spark.createDataFrame([("a" * 300 + "b",), ("a" * 300 + "c",), ("a" * 300 + "c",)], "text string")
    assert datasets.normalize_documents(rows, "x").select("id").distinct().count() == 2


def test_datasets(spark, tmp_path):
    body = "long enough text of an article here"
    (tmp_path / "corpus.json").write_text(json.dumps([{"url": "u1", "title": "T1", "body": body}, {"url": "u2", "title": "T2", "body": body + "!"}, {"url": "u1", "title": "T1", "body": body}, {"url": "u3", "title": "short", "body": "short"}]))
    (tmp_path / "qa.json").write_text(json.dumps({"data": [{"query": "Q?", "answer": "A", "evidence_list": [{"url": "u2", "title": "T2", "fact": "f"}]}, {"query": "", "answer": "x"}]}))
    docs, qa = datasets.normalize_mixed(spark, [str(tmp_path / "corpus.json"), str(tmp_path / "qa.json")], limit_docs=1)
    assert [d.id for d in docs.collect()] == ["u2"]
    (row,) = qa.collect()
    assert (row.text, row.answer, row.evidence[0].url) == ("Q?", "A", "u2")
    assert datasets.guess_kind("x.json", ["Question", "answer"]) == "qa" and datasets.guess_kind("x.json", ["text"]) == "documents" and datasets.guess_kind("news_qa.json", []) == "qa"
    long = "paragraph text that is long enough to count"
    raw = [{"id": "q1", "question": "Q", "answer": "A", "paragraphs": [{"idx": 0, "title": "P", "paragraph_text": long, "is_supporting": True}, {"idx": 1, "title": "P", "paragraph_text": "short", "is_supporting": True}]}, {"id": "q2", "question": "Q2", "answer": "B", "paragraphs": [{"idx": 0, "title": "P", "paragraph_text": long, "is_supporting": False}]}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, raw)))
    docs, qa = datasets.normalize_paragraph_qa(datasets.read_raw(spark, str(tmp_path / "m.jsonl")))
    (doc,) = docs.collect()
    hops = {r.qid: (r.hop_count, [e.url for e in r.evidence]) for r in qa.collect()}
    assert hops == {"q1": (1, [doc.id]), "q2": (0, [])}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", {"k": "v"}, ["x"])], "a string, m map<string,string>, l array<string>")
    sinks.export_table(df, str(tmp_path), "t")
    assert spark.read.parquet(f"{tmp_path}/t.parquet").first().m == '{"k":"v"}' and spark.read.json(f"{tmp_path}/t.jsonl").first().a == "b"
    index = build_index(spark.createDataFrame([("d1", "Old Mill causes River Town & Sea.")], "id string, text string"))
    told = sinks.export_graph(spark, index, f"{tmp_path}/g")
    assert told["nodes"] == 2 and told["edges"] == 1 and "graphml_error" not in told and "html_error" not in told
    assert 'source="Old Mill"' in (tmp_path / "g" / "graph.graphml").read_text() and "Old Mill" in (tmp_path / "g" / "graph.html").read_text()
    assert sinks.manifest(index)["counts"]["edges"] == 1


def test_stream_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "Old Mill causes River Town."), ("d2", "Old Mill causes River Town. Up North hosts Down South.")], "id string, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = extract.stream_rows(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"))
    q = extract.append_rows(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 3 and {r.weight for r in extract.edge_counts(got).collect()} == {1, 2}


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(json.dumps({"id": f"u{k}", "text": f"Old Mill causes River Town{k}. fact {k}.", "title": f"T{k}"}) for k in range(4)))
    counts = cli.run(spark, ["index", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "ix")])
    assert counts["documents"] == 4 and counts["edges"] == 4
    found = cli.run(spark, ["retrieve", "--index", str(tmp_path / "ix"), "--query", "fact 2", "--top-k", "2"])
    assert len(found["ranked_documents"]) == 2 and sum(c["token_count"] for c in found["context"]) <= 1200
    shown = cli.run(spark, ["visualize", "--index", str(tmp_path / "ix"), "--output", str(tmp_path / "viz")])
    assert shown["nodes"] == 5
    qa = [(f"q{k}", f"fact {k}", "x", [(f"u{k}", None)], "t") for k in range(20)]
    spark.createDataFrame(qa, "qid string, text string, answer string, evidence array<struct<url:string,title:string>>, question_type string").write.parquet(f"{tmp_path}/qa")
    assert sum(cli.run(spark, ["split", "--qa", f"{tmp_path}/qa", "--output", f"{tmp_path}/split"]).values()) == 20
    with pytest.raises(SystemExit):
        cli.run(spark, ["nothing"])
    assert Index.load(spark, str(tmp_path / "ix")).reports.count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "id", "score", "rank"] and df.where(F.col("rank") == 1).count() == 40
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_scratch_tables_go_with_their_scope(spark):
    import os

    from tessera.storage import materialize, scratch

    paths = lambda df: [f.removeprefix("file:") for f in df.inputFiles()]
    with scratch(spark):
        with scratch(spark):
            inner, kept = materialize(spark.range(3), "a"), materialize(spark.range(4), "b", keep=True)
            assert all(map(os.path.exists, paths(inner)))
        assert not any(map(os.path.exists, paths(inner))) and kept.count() == 4
    assert not any(map(os.path.exists, paths(kept)))
    assert materialize(spark.range(5), "c").count() == 5


def test_csv_rows_are_parsed_piece_by_piece():
    """The rows come as they are asked for, not as one list: the first is there before a later one is decoded."""
    content = b"id,text\r\n" + b"".join(b'%d,"a ""word"",\r\nand more"\r\n' % k for k in range(5000)) + b'7,"\xff"\r\n'
    rows = files.parse_file(".csv", content)
    assert not isinstance(rows, list)
    parts = list(files.pieces(("f", k, *r) for k, r in enumerate(rows)))
    assert [len(p) for p in parts] == [1000] * 5 + [1]
    assert parts[0][3] == ("f", 3, '3 a "word",\r\nand more', {"id": "3", "text": 'a "word",\r\nand more'}, []) and parts[-1][0][2] == "7 �"
    large = list(files.pieces([("f", k, "x" * files.PIECE_CHARS) for k in range(3)]))
    assert [len(p) for p in large] == [1, 1, 1]


def test_pages_are_converted_a_few_at_a_time():
    pages = [None if k % 50 == 3 else f"<p>a{k} &lt;</p>\n<b> b </b>" for k in range(3 * files.PAGES + 5)]
    got = files.html_to_text.func(pa.array(pages, pa.string()))  # an Arrow array in and out; no pandas series of a whole batch
    assert got.to_pylist() == ["" if p is None else f"a{k} < b" for k, p in enumerate(pages)]
    assert files.html_to_text.func(pa.array([], pa.string())).to_pylist() == []
