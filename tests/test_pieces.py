"""Batches of token lists are worked on in pieces of bounded size."""

import numpy as np
import pyarrow as pa

from tessera.operators import scoring


def test_pieces_bound_texts_and_tokens_and_lose_none(monkeypatch):
    monkeypatch.setattr(scoring, "TOKENS_AT_ONCE", 100)
    monkeypatch.setattr(scoring, "TEXTS_AT_ONCE", 8)
    size = np.random.default_rng(1).integers(0, 60, 300)
    size[[0, 5, 299]] = 1000, 1000, 0
    lists = [["x"] * int(n) for n in size]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(lists, pa.list_(pa.string()))], ["id", "tokens"])
    found = list(scoring.pieces(batch, 1))
    assert [i for x in found for i in x.column(0).to_pylist()] == list(range(300))
    for x in found:
        tokens = sum(map(len, x.column(1).to_pylist()))
        assert 1 <= x.num_rows <= 8 and (tokens <= 100 or x.num_rows == 1)
    assert list(scoring.pieces(batch.slice(0, 0), 1)) == []
