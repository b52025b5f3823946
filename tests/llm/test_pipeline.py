"""The pipeline against brute force, stage by stage and as a whole, on a small corpus with all kinds of odd rows."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tessera.llm import mixing, packing, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the stages use for themselves, as columns of the table.
CLASHES = ["score", "predicted", "part", "rows", "key", "name", "other_name", "turn", "row_name", "times", "number", "starts", "digest", "rank", "bin", "size", "taken", "_id", "_k", "_d"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES) + ", extra map<string,int>"


def corpus(seed=7):
    r = random.Random(seed)
    words = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    texts = [" ".join(words(r.randrange(3, 120))) for _ in range(150)]
    bad = ["vilest", "wretch", "rotter", "knavish"]
    for k in range(0, 150, 4):  # toxic sentences
        w = texts[k].split()
        w.insert(r.randrange(len(w)), f"you {r.choice(bad)} {r.choice(bad)}.")
        texts[k] = " ".join(w)
    base, passage = words(300), words(40)
    texts += [" ".join(base)] * 3
    for _ in range(12):  # near copies
        w = list(base)
        for _ in range(r.randrange(1, 12)):
            w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
        texts.append(" ".join(w))
    for _ in range(15):  # a passage in common
        own = words(r.randrange(20, 60))
        at = r.randrange(len(own))
        texts.append("\n".join([" ".join(own[:at]), "  ".join(passage), " ".join(own[at:])]))
    texts += ["  ".join(passage), None, "", " \t ", "one", "one two", " ".join(words(9000))]
    rows = [(i, t, "en", r.choice(["a", "b", "c", None])) for i, t in enumerate(texts)]
    rows += [(None, "text without an id", "en", "a"), (None, None, None, None), rows[20], rows[20], (20, rows[20][1], "de", "b"), (21, "another text of this id", "en", "c")]
    r.shuffle(rows)
    labels = [(i, 1, int(i % 4 == 0)) for i in range(150)] + [(None, 1, 1), (3, 1, None), (0, 1, 0)]
    full = [(i, t, lang, s, None if t is None else len(t), *[f"{c}{k}" for c in CLASHES], {"k": k}) for k, (i, t, lang, s) in enumerate(rows)]
    return full, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plain(rows):
    """Rows as sorted tuples of texts."""
    return sorted(tuple(map(str, r)) for r in rows)


def clean(spark, rows, folder):
    df, labels = spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.Model(*toxicity.train(df, labels))
    return [r for r in rows if model.score(r[1])[0] < 0.5]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def unlike(rows):
    """One row of each near-duplicate group."""
    digest = [hashlib.md5((r[1] or "").encode()).hexdigest() for r in rows]
    sets = {d: shingles(r[1]) for d, r in zip(digest, rows, strict=True)}
    names = sorted(sets)
    root = {n: n for n in names}
    for i, a in enumerate(names):
        for b in names[:i]:
            if sets[a] and sets[b] and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {n: low if x == high else x for n, x in root.items()}
    kept = {}
    for d, r in zip(digest, rows, strict=True):
        order = (r[0] is None, r[0] or 0, d, [(x is not None, x or "") for x in r[2:-1]])
        if root[d] not in kept or order < kept[root[d]][0]:
            kept[root[d]] = (order, r)
    return [r for _, r in kept.values()]


def cut(rows):
    """Rows without the passages that a smaller doc_id has."""
    number = lambda i: (1 << 63) if i is None else i
    first = {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, 1 << 63), number(r[0]))
    out = []
    for r in rows:
        found = [m.span() for m in WORD.finditer(r[1] or "")]
        w = [r[1][a:b] for a, b in found]
        drop = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < number(r[0]):
                drop[k : k + 13] = [True] * 13
        if not any(drop):
            out.append(r)
        elif not all(drop):
            text, end = "", 0
            for k, (a, b) in enumerate(found):
                if drop[k] and (not k or not drop[k - 1]):
                    text += r[1][end:a]
                if drop[k]:
                    end = b
            text += r[1][end:]
            out.append((r[0], text, *r[2:4], len(text), *r[5:]))
    return out


def mixed(rows):
    """(doc_id, text, source) as often as the mix takes them."""
    documents = pd.DataFrame([(r[0], r[1], r[3]) for r in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841 - read by the SQL
    taken = duckdb.sql(f"SELECT m.*, d.text, d.source FROM ({mixing.OP8_SQL.replace('SELECT doc_id, size, source_size', 'SELECT doc_id, text, source, size, source_size').replace('SELECT doc_id, source,', 'SELECT doc_id, text, source,')}) m JOIN (SELECT 1) ON true JOIN documents d ON d.doc_id IS NOT DISTINCT FROM m.doc_id AND d.text IS NOT DISTINCT FROM m.text AND d.source IS NOT DISTINCT FROM m.source").df()
    out = []
    for r in taken.drop_duplicates(["doc_id", "text", "source"]).itertuples():
        if r.taken:
            out += [(None if pd.isna(r.doc_id) else int(r.doc_id), r.text, r.source)] * -(-int(r.taken) // int(r.size))
    return out


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    for (_, stage), brute in zip(corpus_pipeline.STAGES[:3], (lambda rows: clean(spark, rows, folder), unlike, cut), strict=False):
        docs = stage(spark, docs, folder)
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
        want, rows = plain(brute(rows)), [tuple(r) for r in docs.collect()]
        assert plain(rows) == want and 0 < len(rows)
        docs = spark.createDataFrame(rows, SCHEMA)
    # after near-dedup no row is equal to another in id and text
    docs = corpus_pipeline.mix_sources(spark, docs, folder)
    assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    want, known = mixed(rows), {tuple(map(str, r)) for r in rows}
    rows = [tuple(r) for r in docs.collect()]
    assert plain((r[0], r[1], r[3]) for r in rows) == plain(want) and {tuple(map(str, r)) for r in rows} <= known
    packed = corpus_pipeline.pack_batches(spark, docs, folder).toPandas()
    lengths = sorted(len(WORD.findall(r[1] or "")) for r in rows)
    values = sorted(set(lengths))
    ends = np.array(packing.optimal_boundaries(values, [lengths.count(v) for v in values], [v * lengths.count(v) for v in values]))
    assert sorted(packed.n_tokens) == lengths
    assert (packed.bucket_tokens == ends[np.searchsorted(ends, packed.n_tokens)]).all()


def test_run_is_the_stages_one_after_the_other(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    columns = ["doc_id", "n_tokens", "bucket", "bucket_tokens", "batch", "slot", "batch_rows"]
    assert out.columns == columns and plain(out.collect()) == plain(docs.collect())
    again = corpus_pipeline.run(spark, folder)
    assert plain(again.collect()) == plain(out.collect())


def test_empty_tables_stay_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = -1")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_test_data_keeps_the_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = docs.count()
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 0 < docs.count() < first


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 13))
