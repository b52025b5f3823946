"""Language-model scores, toxicity, fingerprints, chat formatting against brute force and held-out labels."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import cdc, chat, lm, toxicity


def texts(seed, n):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(["a", "the", "Cat", "dog", "sat", "on", f"w{r.randrange(50)}"]) for _ in range(r.randrange(0, 40)))) for i in range(n)]


EDGES = [(None, "the cat"), (900, None), (901, ""), (902, "  \t"), (3, "the cat sat"), (3, "the cat sat"), (903, "long " * 5000)]


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_CHARS", 3000)
    monkeypatch.setattr(lm, "PIECE", 7)
    rows = texts(1, 60) + EDGES
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, part string, score int")
    got = sorted(map(tuple, lm.score_documents(df).collect()), key=str)
    count = Counter()
    tokens = [[*(t or "").lower().split(), None] for _, t in rows]
    train = [i is None or zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    for w, ok in zip(tokens, train, strict=True):
        if ok:
            whole = ["<s>", *w]
            count.update(tuple(whole[max(0, k) : k + n]) for n in (1, 2, 3) for k in range(1 if n == 1 else 0, len(whole) - n + 1))
            count["<s>",] += 1
    uni = {g[0]: c for g, c in count.items() if len(g) == 1 and g != ("<s>",)}
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))

    def p(context, w):
        if not context:
            return p1(w)
        prior = lm.PRIORS[len(context) - 1]
        return (count[(*context, w)] + prior * p(context[1:], w)) / (count[context] + prior)

    def score(w):
        whole = ["<s>", *w]
        return sum(math.log10(p(tuple(whole[max(0, k - 2) : k]), whole[k])) for k in range(1, len(whole)))

    want = [(i, not ok, len(w), sum(x in uni for x in w), n, sum(math.log10(p1(x)) for x in w), score(w)) for (i, _), w, ok in zip(rows, tokens, train, strict=True)]
    assert [g[:5] for g in got] == [x[:5] for x in sorted(want, key=lambda x: str(x))]
    for g, x in zip(got, sorted(want, key=str), strict=True):
        assert g[5:] == pytest.approx(x[5:], rel=1e-9)
    vocabulary = [*uni, "unseen"]
    for a in (("<s>",), ("the",), ("w1", "the"), ("the", "cat")):  # arcs and failure arcs share out exactly the whole mass
        assert sum(p(a, b) for b in vocabulary) == pytest.approx(1.0)
    assert lm.score_documents(df.where("doc_id = -5")).collect() == []


def test_lm_ngrams_seen_once_are_arcs(spark):
    """A held-out copy of one training document scores by its trigrams, not by its words alone."""
    train, held = (next(i for i in range(100) if (zlib.crc32(str(i).encode()) % 5 == 1) == out) for out in (False, True))
    text = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(train, text), (held, text)], "doc_id long, text string")
    got = {x.doc_id: x for x in lm.score_documents(df).collect()}[held]
    p1 = 1.5 / (51 + 0.5 * 52)
    p2 = (1 + lm.PRIORS[0] * p1) / (1 + lm.PRIORS[0])
    p3 = (1 + lm.PRIORS[1] * p2) / (1 + lm.PRIORS[1])
    assert got.held_out and got.base_score == pytest.approx(51 * math.log10(p1))
    assert got.score == pytest.approx(math.log10(p2) + 50 * math.log10(p3))


def test_lm_automaton_carries_its_state():
    """The next state is the longest context seen in training that ends the tokens read."""
    part = lm.Part([0, 2], ["a b c", "a b d"])
    model = lm.automaton(part, part.word_count, part.gram_count, int(part.word_count.sum()), len(part.words), 2)
    number = {w: int(np.searchsorted(part.words, lm.token_ids(w)[0])) for w in "abcd"}
    state = np.array([1])
    for w in "ab":
        _, state = model.step(state, np.array([number[w]]))
    assert int(part.order[state[0] - 2 - len(part.words)]) == 0  # a bigram as context
    cost, after = model.step(state, np.array([number["a"]]))  # not seen: two failure arcs, then the root's arc
    want = model.failure[state] + model.failure[model.shorter[state]] + model.root[number["a"]]
    assert cost == pytest.approx(want) and after[0] == number["a"] + 2


def test_toxicity_learns_from_document_labels(spark):
    r = random.Random(5)
    bad = ["vilest", "wretch", "rotter", "knavish"]
    rows, labels = [], []
    for i in range(600):
        w = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randrange(300)}x" for _ in range(r.randrange(20, 80))]
        for k in range(8, len(w), 9):
            w[k] += "."
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), "en"))
        labels.append((i, 1, toxic))
    rows += [(None, "vilest wretch. calm.", None), (900, None, "en"), (901, "", "en"), (902, "...\n!", "en"), (5, rows[5][1], "fr")]
    labels += [(None, 1, 1), (3, 1, None), (0, 1, 0)]
    df = spark.createDataFrame([(*x, 9.0, "p") for x in rows], "doc_id long, text string, lang string, score double, toxic string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.classify(df, marks).collect()
    assert len(got) == len(rows) and got[0].toxic == "p"
    by = {(x.doc_id, x.text): x for x in got}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(by[rows[i][0], rows[i][1]].predicted == labels[i][2] for i in held)
    assert right >= 0.97 * len(held)
    for i in held:
        x = by[rows[i][0], rows[i][1]]
        if x.predicted and labels[i][2]:
            assert any(b in x.text[x.worst_start : x.worst_end] for b in bad)
    assert by[900, None].score == by[901, ""].score == by[902, "...\n!"].score == 0.0
    long = "calm words here. " * 30_000
    far = spark.createDataFrame([(5001, long), (5002, long + "vilest wretch knavish rotter."), (5002, long)], "doc_id long, text string")
    model = toxicity.Model(*toxicity.train(df, marks))
    told = {(x.doc_id, len(x.text or "")): x for x in toxicity.classify(far.unionByName(df.select("doc_id", "text")), marks).collect()}
    assert told[5001, len(long)].score == told[5002, len(long)].score <= told[5002, len(long) + 29].score
    assert told[5002, len(long) + 29].worst_start == len(long) - 1 and model.score("vilest wretch.")[0] > 0.5
    assert toxicity.classify(df.where("doc_id = -1"), marks).collect() == []
    assert {x.predicted for x in toxicity.classify(df, marks.where("toxic = 0")).collect()} == {0}


def test_toxicity_learns_from_documents_that_begin_alike(spark):
    """Documents under one header are different documents; only copies of a whole text count once."""
    r = random.Random(8)
    header = "Archive of the public mailing list, message as received by the list server. "
    rows, labels = [], []
    for i in range(300):
        toxic = int(i % 3 == 0)
        words = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('klmnp')}{r.choice('aeiou')}" for _ in range(20)]
        rows.append((i, header + " ".join(words[:10] + ["vilest wretch"] * toxic + words[10:])))
        labels.append((i, toxic))
    rows += [(i, rows[1][1]) for i in range(300, 320)]
    labels += [(i, 0) for i in range(300, 320)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    training = {(rows[i][1], toxic) for i, toxic in labels if zlib.crc32(str(i).encode()) % 5}
    assert sorted(map(tuple, toxicity.training_sample(docs, marks).collect())) == sorted(training)
    got = {x.doc_id: x.predicted for x in toxicity.classify(docs, marks).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i] == labels[i][1] for i in held)


def test_fingerprint_documents(spark):
    r = random.Random(6)
    long = "".join(r.choice("abcdefgh ij") for _ in range(300_000))
    rows = [(i, " ".join(f"w{r.randrange(999)}" for _ in range(r.randrange(400)))) for i in range(40)] + [(None, "é" * 99), (50, None), (51, ""), (7, "again"), (52, long), (53, long)]
    df = spark.createDataFrame([(*x, "z", 3) for x in rows], "doc_id long, text string, part string, end int")
    got = cdc.fingerprint_documents(df).collect()
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), cdc.as_text(cdc.chunk_set(t)), cdc.as_text(cdc.chunk_set(new))))
    assert sorted(map(str, (tuple(g)[:5] for g in got))) == sorted(map(str, want))
    by = {g.doc_id: g for g in got}
    assert by[52].fingerprint == by[53].fingerprint and by[53].near_next == 1.0 and 0.45 < by[52].near_edited < 0.52
    assert all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)
    assert cdc.fingerprint_documents(df.where("doc_id = 99")).collect() == []
    alone = cdc.fingerprint_documents(df.where("doc_id = 52")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000))
def test_chunks_cover_the_text_within_their_sizes(data):
    ends = cdc.chunk_ends(data)
    sizes = np.diff([0, *ends])
    assert (ends[-1] if ends else 0) == len(data)
    assert all(s <= cdc.MOST for s in sizes) and all(s >= cdc.LEAST for s in sizes[:-1])


@pytest.mark.parametrize("size", [250, 350, 500])
def test_passages_inside_other_texts_are_found(size):
    r = random.Random(size)
    words = lambda n: " ".join(f"{r.choice('bcdfgst')}{r.choice('aeiou')}{r.choice('lmnr')}{r.choice(['', 'e', 'ing', 'tion'])}" for _ in range(n))
    found = 0
    for _ in range(200):
        passage = words(200)[:size]
        whole = words(r.randrange(20, 400)) + " " + passage + " " + words(r.randrange(20, 400))
        found += cdc.containment(cdc.chunk_set(passage), cdc.chunk_set(whole)) > 0
    assert found >= 190


def test_short_texts_share_their_beginning():
    r = random.Random(2)
    words = lambda n: " ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randrange(999)}" for _ in range(n))
    near = []
    for _ in range(200):
        text = words(r.randrange(20, 50))
        near.append(cdc.containment(cdc.chunk_set(text), cdc.chunk_set(cdc.edited(text, words(60)))))
    assert sum(x > 0 for x in near) > 150 and 0.2 < sum(near) / len(near) < 0.6


def test_chunks_resist_shifts():
    r = random.Random(7)
    text = "".join(r.choice("abcdefghijklmnop ") for _ in range(20_000))
    assert cdc.containment(cdc.chunk_set(text), cdc.chunk_set("shifted by this " + text)) > 0.95
    assert cdc.containment(cdc.chunk_set(text), cdc.chunk_set(text[::-1])) == 0.0


@settings(max_examples=200, deadline=None)
@given(st.text(), st.lists(st.tuples(st.text(), st.text()), max_size=5))
def test_chat_round_trip(said, more):
    template = chat.Template()
    turns = [("assistant", said), *more, ("user", chat.OPEN + said + chat.CLOSE)]
    pieces = list(template.render([{"role": a, "text": b} for a, b in turns]))
    read = [(chat.unescape(t["role"]), chat.unescape(t["text"])) for t in template.read(p for p, _ in pieces)]
    assert read == turns
    assert [chat.unescape(p) for p, marked in pieces if marked] == [b for a, b in turns if a == "assistant"]


def test_template_language():
    run = lambda source, **names: "".join(t for t, _ in chat.Template(source).pieces(names))
    assert run("{% set x = 'a' + 'b' %}{{ x|upper }}{# note #}{% if n == 1 %}one{% elif n == 2 %}two{% else %}many{% endif %}", n=2) == "ABtwo"
    assert run("{% for m in ms %}{{ m.a }}{% if not m.b and m.a != 'q' %}!{% endif %}{% endfor %}", ms=[{"a": "p"}, {"a": "q"}]) == "p!q"
    assert run("{{ 1 + 2 }}{{ missing.field }}{{ 'it\\'s' }}") == "3it's"
    assert list(chat.Template("a{% generation %}b{{ 'c' }}{% endgeneration %}d").pieces({})) == [("a", False), ("bc", True), ("d", False)]
    assert chat.fold(chat.Parser("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}").parse()) == ("seq", [("out", ("const", "abcd"))])
    for bad in ("{% for x %}", "{{ x.__class__ }}", "{{ f(1) }}", "{{ x|nope }}", "{% if a %}", "{% import os %}", "{{ a b }}", "{{ }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)


FRAMED = (
    "<BOS>{% set n = 0 %}{% for m in messages %}{% set n = n + 1 %}{% if n == 1 %}[first]{% endif %}"
    "{{ '<|' + m.role|escape + '|>' }}{% generation %}{{ m.text|escape }}{% endgeneration %}{% endfor %}<EOS>"
)


def test_a_conversation_is_rendered_by_one_call():
    """Header and footer come once, names that are set last from turn to turn, and the grammar follows from the template."""
    template = chat.Template(FRAMED)
    turns = [("user", "a <EOS> [b]"), ("x|y", "|> \\ <BOS>"), ("user", "")]
    pieces = list(template.render({"role": a, "text": b} for a, b in turns))
    whole = "".join(p for p, _ in pieces)
    assert whole == r"<BOS>[first]<|user|>a \<EOS> \[b]<|x\|y|>\|> \\ \<BOS><|user|><EOS>"
    for cut in (1, 5, 1000):
        read = template.read(whole[k : k + cut] for k in range(0, len(whole), cut))
        assert [(chat.unescape(t["role"]), chat.unescape(t["text"])) for t in read] == turns
    with pytest.raises(ValueError):
        list(template.read([whole[:-3]]))
    seen = []

    def messages():
        for k in range(3):
            seen.append(k)
            yield {"role": "user", "text": str(k)}

    first = next(p for p, marked in template.render(messages()) if marked)
    assert first == "0" and seen == [0]  # messages are taken one by one


def test_chat_frames_by_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_CHARS", 10)
    df = spark.createDataFrame([(1, k, "user", "some text " * k) for k in range(9)] + [(2, 0, "u", "x")], "conv_id long, turn int, role string, text string")
    formatted = chat.format_conversations(df, FRAMED)
    texts = {}
    for r in sorted(formatted.collect(), key=lambda r: (r.conv_id, r.chunk_no)):
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.formatted
    assert [t.count("<BOS>") + t.count("[first]") + t.count("<EOS>") for t in texts.values()] == [3, 3]
    got = {g.conv_id: g for g in chat.conversation_digests(formatted, FRAMED).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].formatted_chars) == (9, 360, len(texts[1]))


def test_chat_digests(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a: </turn>\n### x"), (-7, 0, "user", said), (-7, 1, "assistant", said), (2, None, None, None), (None, 0, "assistant", "x"), (None, 1, "user", ""), (3, 0, "assistant", "q" * 100_000), (1, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, "m") for r in rows], "conv_id long, turn long, role string, text string, marks string")
    got = {g.conv_id: g for g in chat.conversation_digests(chat.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_conversations(df.where("conv_id = 99"))).collect() == []
