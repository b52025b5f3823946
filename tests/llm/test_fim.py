"""Fill-in-the-middle against a direct form, with chunks small enough that every text has many."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fim


def direct(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    x = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


TEXTS = [
    "", None, "\n", "one line", "a\nb", "a\n\n\nb\n", "é\U0001f600\nß\n" * 40, "<P>", "x <S", "<S" + "y" * 30 + ">\n", "a<<M>b\n" * 3, "<\nP>\n<<P\n>" * 9, "\n" * 50, "long line " * 30 + "\nend",
    "z" * 20 + "<P" + ">" + "w" * 20, "<<<<<S\n" * 12, "M>P>S>\n" * 7,
]


def test_functions_compose_to_the_walk_of_the_automaton():
    automaton = fim.Automaton()
    rng = np.random.default_rng(1)
    for _ in range(60):
        text = "".join(rng.choice(list("<PSM>\nab")) for _ in range(int(rng.integers(0, 40))))
        cuts = sorted(rng.integers(0, len(text) + 1, 2).tolist())
        parts = [automaton.scan(x) for x in (text[: cuts[0]], text[cuts[0] : cuts[1]], text[cuts[1] :])]
        ends, counts = automaton.fold((np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])))
        whole = automaton.scan(text)
        assert (ends == whole[0]).all() and (counts == whole[1]).all()
        assert counts[0, 0] == len(re.findall(r"[^\n]*\n|[^\n]+", text))
        assert (ends[0, 0] % automaton.marks == automaton.found) == any(s in text for s in fim.SENTINELS)


@pytest.mark.parametrize("chunk, block", [(5, 3), (1 << 16, 256)])
def test_equals_the_direct_form(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    monkeypatch.setattr(fim, "BLOCK", block)
    data = [(i if i != 5 else None, x, i, "c") for i, x in enumerate(TEXTS * 3)] + [(2, "\n", 2, "c"), (6, TEXTS[6], 6, "c"), (6, TEXTS[6], 7, "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, fim_lines int, Name string").repartition(3)
    got = fim.fill_in_middle(df)
    assert got.columns == ["doc_id", "text", "fim_lines", "Name", "fim_lines_", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output"]
    back = got.select("doc_id", "fim_lines_", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output", fim.restore(F.col("fim_output"), F.col("fim_form")).alias("back"), "text").collect()
    assert sorted(map(repr, [tuple(r)[:6] for r in back])) == sorted(map(repr, [direct(d[0], d[1]) for d in data]))
    assert all(r.back == (r.text or "") for r in back)


def test_rates_and_orders(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit("\nb\nc")).alias("text"))
    for rate, spm in ((0, 50), (40, 0), (100, 100)):
        got = {tuple(r) for r in fim.fill_in_middle(df, rate=rate, spm=spm, seed=3).drop("text").collect()}
        assert got == {direct(i, f"{i}\nb\nc", rate, spm, 3) for i in range(300)}


def test_empty_table(spark):
    assert fim.fim_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
