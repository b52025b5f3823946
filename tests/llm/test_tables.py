"""WARC round trips, the epsilon join, mixing and packing against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.llm import ego, mixing, packing, queries, warc

PAGE = "page_id long, url string, html string, digest string, first long"


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 700)
    body = "WARC/1.1\r\n\r\n0\r\n\r\n" + "ä" * 150
    rows = [(3, "u3", body), (1, "u1", body), (2, None, body), (4, "a b\n", "short"), (5, "v", "short"), (6, "v", None), (7, "v", ""), (None, "w", "y" * 200), (8, "w", "z" * 9000), (9, "w", "z" * 9000), (8, "w", "z" * 9000), (None, None, "n" * 300)]
    df = spark.createDataFrame([(*r, "d", 5) for r in rows], PAGE)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    first = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = first.get(h) if first.get(h) != i else None
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2], x[3]))
    assert {r.status for r in warc.round_trip(df).collect()} == {"ok"}
    assert warc.round_trip(df.where("page_id = 99")).collect() == []


def archive(spark, tmp_path, name, records):
    folder = tmp_path / name
    folder.mkdir()
    for k, data in enumerate(records):
        (folder / f"{k}.warc").write_bytes(data)
    return {r.page_id: r for r in warc.read_archives(spark, str(folder)).collect()}


def test_broken_segments_are_told(spark, tmp_path):
    make = lambda page, text, cut=200: list(warc.page_records(f"00000000-0000-0000-0000-00000000000{page}", page, "u", text, hashlib.sha256(text).hexdigest(), None, cut))
    whole, lost, double, alone = make(1, b"a" * 900), make(2, b"b" * 900), make(3, b"c" * 900), make(4, b"d" * 900)
    short = [r.replace(b"Segment-Total-Length: ", b"Segment-Total-Length: 9") for r in make(5, b"e" * 900)]
    wrong = [make(6, b"f" * 50)[0].replace(b"ffffff", b"gggggg", 1)]
    framing = [make(7, b"h" * 50)[0].replace(b"\r\n32\r\n", b"\r\n3x\r\n")]
    records = [*reversed(whole), *lost[:1], *lost[2:], *double, double[1], *alone[1:], *short, *wrong, *framing]
    random.Random(1).shuffle(records)
    got = archive(spark, tmp_path, "x", records)
    assert {p: r.status for p, r in got.items() if p} == {1: "ok", 2: "segments", 3: "segments", 5: "length", 6: "digest", 7: "framing", **({4: "orphan"} if 4 in got else {})}
    assert got[1].payload_digest == hashlib.sha256(b"a" * 900).hexdigest() and got[1].payload_bytes == 900


@pytest.mark.parametrize("payload", [b"", b"x", b"0\r\n\r\n" * 2000, bytes(range(256)) * 100])
def test_chunked_framing(payload):
    assert warc.dechunk(warc.chunked(payload, 7)) == payload
    with pytest.raises(ValueError):
        warc.dechunk(warc.chunked(payload, 7)[:-4])


def brute_links(vectors, threshold):
    n = len(vectors)
    unit = []
    for v in vectors:
        ok = v is not None and len(v) and None not in v and all(np.isfinite(v)) and any(v)
        x = np.array(v, float) / np.abs(v).max() if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    links = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= threshold
    return [[j for j in range(n) if j != i and links(unit[i], unit[j])] for i in range(n)]


def test_epsilon_join(spark, monkeypatch):
    monkeypatch.setattr(ego, "BLOCK_BYTES", 12 * 64)
    monkeypatch.setattr(ego, "LEAF", 4)
    monkeypatch.setattr(ego, "FAN", 3)
    monkeypatch.setattr(ego, "TILE", 2)
    g = np.random.default_rng(3)
    base = g.normal(size=(25, 8))
    vectors = [v.tolist() for v in base] + [(base[k % 6] + 0.12 * g.normal(size=8)).tolist() for k in range(150)]
    vectors += [[0.0] * 8, None, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 7, [], (base[0] * 1e-200).tolist(), vectors[3]]
    vectors += [[1.0, 2.0], [1.0, 2.1], [-1.0, 2.0], [1.0, 2.0], [3.0], [5.0], [-1.0], *[vectors[2]] * 30, vectors[3]]
    ids = list(range(len(vectors) - 1)) + [3]
    ids[40] = None
    df = spark.createDataFrame([(i, v, 1, "r") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, label int, rid string")
    links = brute_links(vectors, 0.9)
    root = list(range(len(vectors)))
    for i, near in enumerate(links):
        for j in near:
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    want = []
    for i in range(len(vectors)):
        known = [ids[j] for j in range(len(vectors)) if root[j] == root[i] and ids[j] is not None]
        low = min(known) if known else None
        want.append((str(ids[i]), len(links[i]), low, ids[i] == low))
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in ego.epsilon_join(df).collect())
    assert got == sorted(want)
    assert ego.epsilon_join(df.where("vec_id = -1")).collect() == []


def test_intervals_keep_every_near_pair_of_blocks(spark, monkeypatch):
    """The recursion finds just the pairs of blocks whose boxes are near, on several levels."""
    monkeypatch.setattr(ego, "FAN", 3)
    g = np.random.default_rng(5)
    low = np.cumsum(g.uniform(0, 0.3, size=(50, 1)), axis=0) + g.uniform(-0.2, 0.2, size=(50, ego.BOX_DIMS + 1))
    boxes = np.stack([low, low + g.uniform(0, 0.2, size=low.shape)], 1)
    meta = spark.createDataFrame([(k, b.ravel().tolist()) for k, b in enumerate(boxes)], "block long, box array<double>")
    near = ego.near_boxes(boxes, boxes, 2 - 2 * 0.7 + 1e-9)
    got = sorted((r.a, r.b) for r in ego.block_pairs(meta, 0.7).collect())
    want = [(i, j) for i in range(50) for j in range(i, 50) if near[i, j]]
    assert got == want and 50 < len(want) < 600


def test_mix_equals_its_sql(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["a", "b", "c", "d", None]), " ".join("w" * r.randrange(60))) for i in range(300)]
    rows += [(900, "tiny", "one word"), (901, "empty", ""), (902, "empty", None), (None, "a", "no id"), (7, "a", "again and again"), (7, "a", "again and again"), (903, "big", "x " * 20_000)]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, source string, text string, size int, rank string")
    got = mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    documents = pd.DataFrame(rows, columns=["doc_id", "source", "text"]).astype({"doc_id": "Int64"})  # noqa: F841 - read by the SQL
    want = duckdb.sql(mixing.OP8_SQL).df()
    order = ["doc_id", "size", "taken"]
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True).astype(float), want.sort_values(order)[got.columns].reset_index(drop=True).astype(float))
    full = mixing.mix(df).toPandas()
    for _, own in full.groupby("source", dropna=False):
        assert own.taken.sum() == int(own.target.iloc[0]) and (own.taken <= 3 * own["size"]).all() and own.target.iloc[0] <= 3 * own.source_size.iloc[0]
    assert full.groupby("source", dropna=False).target.first().sum() == pytest.approx(full["size"].sum())
    assert mixing.mix(df.where("doc_id = -1")).collect() == []
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.where("doc_id = 901").count() == 0
    wanted = full.assign(n=-(-full.taken // full["size"].clip(lower=1))).groupby("doc_id", dropna=False).n.sum()
    found = mixed.toPandas().groupby("doc_id", dropna=False).size()
    assert {str(k): v for k, v in found.items()} == {str(k): v for k, v in wanted.items() if v}


def test_equal_rows_share_what_the_mix_takes(spark):
    """Two of three equal rows are taken, one of them at the cut: two rows come out, not three times the largest share."""
    rows = [(1, "a", "x " * 8)] * 3 + [(2, "b", "y " * 10)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, source string, text string, times int")
    taken = sorted(r.taken for r in mixing.mix(df).where("doc_id = 1").collect())
    got = mixing.mixed(df)
    assert got.where("doc_id = 1").count() == sum(-(-t // 8) for t in taken) and taken == [0, 3, 8] or sum(taken) == int(mixing.mix(df).where("doc_id = 1").first().target)
    assert sorted(r.times for r in got.where("doc_id = 1").collect()) == list(range(got.where("doc_id = 1").count()))


def brute_padding(lengths, k):
    """Least padding with at most k buckets, by trying all boundaries recursively."""
    values = sorted(set(lengths))
    best = {(-1, 0): 0}
    for used in range(1, k + 1):
        for j in range(len(values)):
            options = [best[i, used - 1] + sum(values[j] - x for x in lengths if (i < 0 or x > values[i]) and x <= values[j]) for i in range(-1, j) if (i, used - 1) in best]
            if options:
                best[j, used] = min(options)
    return min(best[len(values) - 1, u] for u in range(1, k + 1) if (len(values) - 1, u) in best)


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    r = random.Random(seed)
    lengths = [int(r.paretovariate(1.1) * 3) % 200 for _ in range(60)]
    values = sorted(set(lengths))
    ends = packing.optimal_boundaries(values, [lengths.count(v) for v in values], [v * lengths.count(v) for v in values], 4)
    assert len(ends) <= 4 and ends[-1] == max(lengths)
    assert sum(min(e for e in ends if e >= x) - x for x in lengths) == brute_padding(lengths, 4)


def test_pack(spark):
    r = random.Random(9)
    rows = [(i, " ".join("w" * r.choice([1, 3, 50, 51, 400]))) for i in range(500)] + [(None, "no id"), (900, None), (901, ""), (7, "x"), (7, "x"), (902, "y " * 30_000)]
    df = spark.createDataFrame([(*x, 1, "b") for x in rows], "doc_id long, text string, n_tokens int, bucket string")
    got = packing.pack(df, n_buckets=4, token_budget=1000).toPandas()
    assert len(got) == len(rows)
    assert (got.n_tokens <= got.bucket_tokens).all() and got.bucket.nunique() <= 4
    for (_, _), own in got.groupby(["bucket", "batch"]):
        top = own.bucket_tokens.iloc[0]
        assert len(own) == own.batch_rows.iloc[0] == own.slot.nunique() and (len(own) == 1 or len(own) * top <= 1000)
    for _, own in got.groupby("bucket"):
        sizes = own.groupby("batch").size()
        assert list(sizes.index) == list(range(len(sizes))) and (sizes[:-1] == max(1, 1000 // max(own.bucket_tokens.iloc[0], 1))).all()
    assert packing.pack(df.where("doc_id = -1")).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = queries.queries()[name](spark, folder).toPandas(), db.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    order = [c for c in columns if c not in ("score", "base_score", "target")]
    a, b = (x[columns].sort_values(order).reset_index(drop=True) for x in (got, want))
    for c in columns:
        if c in order:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
        else:
            np.testing.assert_allclose(a[c], b[c], rtol=1e-9)
