"""Personal data: base rules against their patterns as they are written, and what the field adds."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii

# the patterns as given, used directly
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checked(kind, text):
    d = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [x * 2 - 9 * (x > 4) if i % 2 else x for i, x in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def direct(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if checked(kind, m.group())]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def base(text):
    return [(pii.KINDS[k], a, b) for a, b, k in pii.base_spans(text)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 0149()\né%", max_size=60))
def test_base_spans_are_the_patterns_matches(text):
    assert base(text) == direct(text)


@pytest.mark.parametrize("text", ["a@b.c@d.e", "@a.b", "x@y", "x@y.z.", "1.2.3.4.5", "300.1.1.1 1.1.1.1", "0000255.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+1 5", "é@é.é", "a.b%+-@x-.y"])
def test_base_spans_by_example(text):
    assert base(text) == direct(text)


def test_base_rules_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "1." * 100_000, "+1" + " " * 200_000, "." * 200_000 + "@"):
        assert pii.spans_of([text], pii.Field.blank())[0] == [(a, b, pii.KINDS.index(k), True, 1.0) for k, a, b in base(text)]


PHONE, MAIL = "+1 ({0}) 555-{1}", "user{0}.x@mail.example.com"


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(7)
    out = []
    for i in range(400):
        area, last = int(rng.integers(200, 999)), int(rng.integers(1000, 9999))
        number, mail = PHONE.format(area, last), MAIL.format(i)
        again = f" Again: {number}, {mail}." if i % 4 == 0 else ""
        out.append(f"He said call {number} soon. Room {int(rng.integers(10, 99))} of {int(rng.integers(1900, 2030))} is free. Write to {mail} or visit 10.{i % 256}.7.9 today, item {int(rng.integers(100, 9999))}-{i}.{again}")
    return out


@pytest.fixture(scope="module")
def field(spark, corpus):
    return pii.train(spark.createDataFrame([(x,) for x in corpus], "text string"))


def added(texts, field):
    return [[(pii.KINDS[k], t[a:b]) for a, b, k, is_base, _ in spans if not is_base] for t, spans in zip(texts, pii.spans_of(texts, field), strict=True)]


def test_repeated_tokens_share_labels(field):
    far = " and then they walked on for a long while" * 30
    text = f"Call +1 (415) 555-2671 now.{far} The number (415) 555-2671 is his, room 12 of 1999."
    alone = f"Once.{far} The code (4155 552-671 77) is his, room 12 of 1999."
    got = added([text, alone], field)
    assert ("phone", "(415) 555-2671") in got[0] and all(k == "phone" for k, _ in got[0])
    assert got[1] == []
    # without links the same tokens are less surely a phone
    cut = pii.Field(field.single, np.concatenate([field.pair[:1], np.zeros_like(field.pair[1:])]))
    sure = lambda f: max([s[4] for s in pii.spans_of([text], f)[0] if not s[3]], default=0.0)
    assert sure(field) > sure(cut)


def test_belief_propagation_is_exact_on_a_tree():
    rng = np.random.default_rng(3)
    field = pii.Field(rng.normal(size=(pii.BUCKETS, pii.LABELS)), rng.normal(size=(4, pii.LABELS, pii.LABELS)))
    feature = rng.integers(0, pii.BUCKETS, (4, pii.SLOTS))
    edges, observed = np.array([[0, 1, 0], [1, 2, 2], [1, 3, 3]]), np.array([-1, -1, 2, -1])
    total = np.zeros((4, pii.LABELS))
    for y in np.ndindex(*[pii.LABELS] * 4):
        if y[2] == 2:
            score = sum(field.single[feature[i]].sum(axis=0)[y[i]] for i in (0, 1, 3)) + sum(field.pair[k][y[a], y[b]] for a, b, k in edges)
            for i in range(4):
                total[i, y[i]] += np.exp(score)
    rounds, pii.ROUNDS = pii.ROUNDS, 60
    try:
        got = field.beliefs(feature, observed, edges)
    finally:
        pii.ROUNDS = rounds
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-6)


def test_links_are_few_and_join_all(spark):
    text = " x ".join(["4155552671"] * 500)
    found = pii.tokens(text, [])
    edges = pii.links(text, found)
    assert len(found) == 500 and len(edges) <= 2 * 500
    assert {j for i, j, _ in edges if i == 0} == set(range(1, 500))


def test_query_on_odd_rows(spark, corpus):
    odd = [None, "", "no digits here", "é " * 1000 + "a@b.cd", "1.1.1.1 " * 3000, "x" * 300_000 + " +1 (555) 555-0000"]
    data = [(i, x, "s") for i, x in enumerate([*odd, *corpus, corpus[0]])] + [(3, odd[3], "s"), (None, odd[4], "s")]
    df = spark.createDataFrame(data, "doc_id long, text string, Spans string").repartition(4)
    wide = pii.find_personal_data(df)
    assert wide.columns == ["doc_id", "text", "Spans", "spans_"] and wide.count() == len(data)
    got = pii.personal_data_digests(df).collect()
    expected = []
    for doc_id, text, _ in data:
        spans = direct(text)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        expected.append((doc_id, *[sum(s[0] == k for s in spans) for k in pii.KINDS], hashlib.sha256(told.encode()).hexdigest()))
    key = lambda r: repr(r)
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted(expected, key=key)
    texts = {d[0]: d[1] for d in data}
    for r in got:
        told = [x for x in r.spans.split(",") if x]
        assert {":".join(map(str, s)) for s in direct(texts[r.doc_id] if r.doc_id is not None else odd[4])} <= set(told) and len(told) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added


def test_empty_tables_and_tables_without_signs(spark):
    schema = "doc_id long, text string"
    assert pii.personal_data_digests(spark.createDataFrame([], schema)).collect() == []
    assert pii.personal_data_digests(spark.createDataFrame([(1, "only 12 words"), (2, None)], schema)).select("spans").distinct().collect()[0].spans == ""
