"""SimHash groups, near duplicates, substring removal and components against brute force on small fixtures."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from tessera.llm import fmindex, simhash
from tessera.operators.graph import linked_components

DOC = "doc_id long, text string, source string, key string, f0 long, digest string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "k", 7, "x") for i, t in rows], DOC)


def family(seed=1):
    """Texts with exact copies, near copies, passages in common, nulls, empties, repeated ids and a long one."""
    r = random.Random(seed)
    words = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    base, passage = words(300), words(60)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, "One  TWO"), (None, "one two"), (6, " ".join(base)), (7, " ".join(base))]
    for i in range(8, 30):
        w = list(base)
        for _ in range(r.randrange(1, 25)):
            w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    for i in range(30, 45):
        own = words(r.randrange(5, 120))
        at = r.randrange(len(own))
        rows.append((i, " ".join(own[:at] + passage[r.randrange(20) :] + own[at:])))
    rows += [(45, " ".join(words(5000) + base)), (6, " ".join(base)), (30, "again " + " ".join(passage))]
    r.shuffle(rows)
    return rows


def groups(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


def lowest(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def test_simhash_groups(spark):
    rows = family()
    prints = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = groups(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    want = sorted((str(rows[i][0]), f"{prints[i]:016x}", lowest([rows[j][0] for j in range(len(rows)) if root[j] == root[i]])) for i in range(len(rows)))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs(spark, rows)).collect())
    assert got == want
    assert simhash.simhash_groups(docs(spark, [])).collect() == []


@pytest.mark.parametrize("n", [50, 4000])
def test_bucket_plan_loses_no_link(spark, n):
    r = random.Random(n)
    values = [r.getrandbits(64) for _ in range(n // 10)]
    while len(values) < n:
        v = r.choice(values)
        for _ in range(r.randrange(5)):
            v ^= 1 << r.randrange(64)
        values.append(v)
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "f0 long")
    links = simhash.fingerprint_links(df, 1, 2, range(1, 4))
    comp = {r.node: r.component for r in linked_components(links, "a0", "b0").collect()}
    a = np.array(sorted({simhash.signed(v) for v in values}), np.int64).view(np.uint64)
    root = np.arange(len(a))
    for i in range(len(a)):
        near = np.nonzero(np.bitwise_count(a ^ a[i]) <= 2)[0]
        for x in set(root[near].tolist()):
            root[root == x] = root[near].min()
    got = [comp.get(int(x), int(x)) for x in a.view(np.int64)]
    assert len(set(got)) == len(set(root.tolist())) == len(set(zip(got, root.tolist(), strict=True)))


def test_allocation_covers_the_threshold():
    bits = np.random.default_rng(1).integers(0, 2, (400, 64)).astype(np.uint8)
    bits[:, 1] = bits[:, 0]
    for tau in (0, 2, 5):
        plan = simhash.plan_partitions(bits, 10**6, tau, range(1, tau + 2))
        assert sum(t + 1 for _, t in plan) >= tau + 1
    assert any({0, 1} <= set(g) for g in simhash.group_bits(bits, 4))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def test_near_duplicates(spark):
    rows = family(3)
    sets = [shingles(t) for _, t in rows]
    same = lambda i, j: (rows[i][1] or "") == (rows[j][1] or "")
    close = lambda i, j: bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    root = groups(len(rows), lambda i, j: same(i, j) or close(i, j))
    got = {(r.doc_id, r.digest): r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    found = [got[rows[i][0], hashlib.md5((rows[i][1] or "").encode()).hexdigest()].group_id for i in range(len(rows))]
    assert len(set(zip(found, root, strict=True))) == len(set(found)) == len(set(root))
    assert sum(r.kept for r in got.values()) == len(set(root))
    for r in got.values():
        if r.kept:
            assert r.doc_id == lowest([rows[i][0] for i in range(len(rows)) if found[i] == r.group_id])
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_near_duplicates_that_repeat_a_line(spark):
    """The repeats of a line change no set of shingles but for the seams, so they must not hide a copy."""
    r = random.Random(11)
    rows = []
    for k, repeats in enumerate((5, 20, 50)):
        base, line = ([f"w{r.randrange(10**6)}" for _ in range(n)] for n in (800, 15))
        rows += [(2 * k, " ".join(base[:400] + line + base[400:])), (2 * k + 1, " ".join(base[:400] + line * (1 + repeats) + base[400:]))]
        assert len(shingles(rows[-1][1]) & shingles(rows[-2][1])) > 0.99 * len(shingles(rows[-1][1]) | shingles(rows[-2][1]))
    got = {x.doc_id: x for x in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert [got[i].kept for i in range(6)] == [True, False] * 3
    assert all(got[2 * k].group_id == got[2 * k + 1].group_id for k in range(3))


def test_near_duplicates_at_the_threshold(spark):
    """Of pairs whose similarity is just 0.8 or little more nearly all are found, of pairs just below none."""
    r = random.Random(13)
    rows, near = [], []
    for k in range(300):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(120, 400))]
        other = list(words)
        cut = int(len(words) * (0.095 if k % 3 else 0.12))  # words at the end that the copy replaces
        other[-cut:] = [f"x{r.randrange(10**6)}" for _ in range(cut)]
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        near.append(len(a & b) >= 0.8 * len(a | b))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    assert 100 < sum(near) < 250
    got = {x.doc_id: x.group_id for x in simhash.near_duplicates(docs(spark, rows)).collect()}
    found = [got[2 * k] == got[2 * k + 1] for k in range(300)]
    assert not any(f and not n for f, n in zip(found, near, strict=True))
    assert sum(found) >= 0.95 * sum(near)


def test_large_clusters_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CLUSTER_BLOCK", 5)
    test_near_duplicates(spark)


def removal(rows):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, 1 << 63), (1 << 63) if i is None else i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        drop = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < ((1 << 63) if i is None else i):
                drop[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, d in zip(w, drop, strict=True) if not d)
        out.append((str(i), len(w), sum(drop), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [4096, 3])
def test_remove_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(fmindex, "PART_CHARS", 20_000)
    monkeypatch.setattr(fmindex, "HOT", hot)
    rows = family(5) + [(50, "a a a a a a a a a a a a a a a a a"), (51, "a " * 40), (52, " ".join("ab"[k % 2] for k in range(60)))]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in fmindex.remove_repeats(docs(spark, rows)).collect())
    assert got == removal(rows)
    assert any(x[2] for x in got)
    assert fmindex.remove_repeats(docs(spark, [])).collect() == []


def test_a_null_id_is_no_larger_id(spark):
    text = " ".join(f"p{k}" for k in range(20))
    got = {r.doc_id: r.n_removed for r in fmindex.remove_repeats(docs(spark, [(None, text), (3, text), (4, "x " + text)])).collect()}
    assert got == {None: 0, 3: 0, 4: 20}


def test_without_repeats_keeps_columns_and_white_space(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, f"a\n{passage}\tb"), (2, f"c  {passage}\n\nd"), (3, passage), (4, None), (5, "")]
    out = {r.doc_id: r for r in fmindex.without_repeats(docs(spark, rows)).collect()}
    assert {i: r.text for i, r in out.items()} == {1: rows[0][1], 2: "c  \n\nd", 4: None, 5: ""}
    assert all(r.source == "s" and r.f0 == 7 for r in out.values())


def test_without_repeats_lets_clashing_names_pass(spark):
    names = ["part", "rows", "starts", "key", "at", "kind", "data", "bucket", "grams", "segment", "low", "_key"]
    text = " ".join(f"p{k}" for k in range(20))
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in ((1, text), (2, f"x {text} y"), (2, f"x {text} y"), (None, text), (4, None))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = fmindex.without_repeats(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], (2, "x  y", *rows[1][2:]), (2, "x  y", *rows[1][2:]), rows[4]], key=str)
    assert fmindex.without_repeats(df.where("doc_id = 77")).collect() == []


def test_fm_index_finds_all_occurrences():
    r = random.Random(2)
    for _ in range(20):
        texts = [[r.randint(1, 3) for _ in range(r.randint(1, 30))] for _ in range(r.randint(1, 10))]
        flat = np.array([x for t in texts for x in [*t, 0]])
        owner = np.array([i for i, t in enumerate(texts) for _ in [*t, 0]])
        index = fmindex.FMIndex(flat, owner, 4, depth=6)
        query = np.array([r.randint(1, 3) for _ in range(40)])
        ends = np.arange(6, 41)
        matched, lo, hi = index.matching(query, ends, 6)
        for e, m, a, b in zip(ends, matched, lo, hi, strict=True):
            held = lambda n, e=e: [i for i, t in enumerate(texts) for s in range(len(t)) if t[s : s + n] == query[e - n : e].tolist()]
            assert m == max((n for n in range(1, 7) if held(n)), default=0)
            if m:
                assert sorted(index.documents[a:b].tolist()) == sorted(held(m))


def test_only_the_index_tells_which_passages_repeat(monkeypatch):
    r = random.Random(3)
    passage = " ".join(f"w{i}" for i in range(20))
    texts = [" ".join(f"x{r.randrange(50)}" for _ in range(8)) + " " + passage + f" y{i}" for i in range(5)]
    texts = [t.encode() for t in texts]
    low = np.array([50, 40, 30, 20, 10])
    found = fmindex.search_shard(texts, low)
    windows = [[b" ".join(t.split()[k : k + 13]) for k in range(len(t.split()) - 12)] for t in texts]
    assert [f.tolist() for f in found] == [[min(d for d, ws in zip(low.tolist(), windows, strict=True) if w in ws) for w in own] for own in windows]
    monkeypatch.setattr(fmindex.WaveletTree, "rank", lambda self, symbol, at: np.zeros_like(at))
    assert [f.tolist() for f in fmindex.search_shard(texts, low)] != [f.tolist() for f in found]


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 470)] + [(500, k) for k in range(501, 560)] + [(9, 9)]
    got = {x.node: x.component for x in linked_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), "a", "b").collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    assert got == {x: root[x] for e in edges if e[0] != e[1] for x in e}
    assert linked_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
