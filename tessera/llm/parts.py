"""Documents dealt into parts that ask, and buckets that answer.

Statistics of the whole corpus are never gathered in one place, and no key of the data decides where a
row goes.  ``deal`` packs whole rows into compressed blobs of (part, rows), parts by a hash of the row,
so that a part is one task's worth however skewed the documents are.  A part asks each distinct key it
holds once, in packets by ranges of 64-bit hashes; a bucket adds up all parts and answers every part in
the order in which it asked.  A key that a third of all documents share is one entry of each part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of rows that a dealing task holds before it passes its blobs on.
HELD_BYTES = 32 << 20
#: Characters of the corpus for each pair of a part and a bucket, at least: keeps packets from getting many and small.
CHARS_PER_PACKET = 500
ODD = 0x9E3779B97F4A7C15
_CODEC = "zstd"


def part_count(chars: int, part_chars: int) -> int:
    """Number of parts: of ``part_chars`` characters each, more where parts times buckets would outgrow the corpus."""
    return max(1, math.ceil(chars / max(part_chars, math.sqrt(chars * CHARS_PER_PACKET))))


def pack_bytes(data) -> bytes:
    """``data`` compressed, after its size."""
    data = memoryview(data)
    return data.nbytes.to_bytes(8, "little") + pa.Codec(_CODEC).compress(data, asbytes=True)


def unpack_bytes(blob: bytes) -> bytes:
    return pa.Codec(_CODEC).decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return pack_bytes(sink.getvalue())


def unpack_tables(blobs: list[bytes]) -> pa.Table | None:
    """All rows of the blobs, None without blobs."""
    found = [pa.ipc.open_stream(unpack_bytes(b)).read_all() for b in blobs]
    return pa.concat_tables(found) if found else None


def pack_counts(counts: np.ndarray) -> bytes:
    """Non-negative integers: a byte each, larger ones after them."""
    big = counts[counts >= 255].astype("<i8")
    return pack_bytes(np.minimum(counts, 255).astype(np.uint8).tobytes() + big.tobytes())


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    data = unpack_bytes(blob)
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences of as many bytes as the largest needs; the first key is whole."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = max(1, -(-int(gaps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    width = blob[0]
    gaps = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(gaps) + 1, 8), np.uint8)
    out[0] = np.frombuffer(blob, np.uint8, 8, 1)
    out[1:, :width] = gaps
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def spread(keys: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit hashes that makes the leading bits even, for hashes chosen for being small too."""
    with np.errstate(over="ignore"):
        return keys * np.uint64(ODD)


def cuts(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Where the ranges of ``buckets`` equal shares of the space of keys of so many bits begin and end in ascending keys."""
    edges = [(b << bits) // buckets for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


def deal(df: DataFrame, part: Column) -> DataFrame:
    """(part, rows): the rows of ``df`` as blobs, all columns and names kept; ``part`` is an int expression over them."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blobs() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            own = table.column(len(names)).to_numpy()
            table = table.select(list(range(len(names)))).rename_columns(names)
            order = np.argsort(own, kind="stable")
            which, first = np.unique(own[order], return_index=True)
            ends = [*first[1:].tolist(), len(order)]
            packed = [pack_table(table.take(pa.array(order[a:b])).combine_chunks()) for a, b in zip(first.tolist(), ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(packed, pa.binary())], ["part", "rows"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > HELD_BYTES:
                yield blobs()
                held, size = [], 0
        if held:
            yield blobs()

    # columns travel by place, so their names clash with nothing
    return df.select("*", part.cast("int")).toDF(*[f"c{k}" for k in range(len(names) + 1)]).mapInArrow(run, "part int, rows binary")


def dealt_rows(table: pa.Table) -> pa.Table | None:
    return unpack_tables(table.column("rows").to_pylist())


def part_of(parts: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), *columns), F.lit(parts)).cast("int")
