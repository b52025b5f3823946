"""Document fingerprints by content-defined chunking.

Normalised gear-hash boundaries cut the UTF-8 text: a chunk ends where the rolling hash of its last 32
bytes has HARD zero bits before the normal size and EASY zero bits after it.  The fingerprint is the
set of chunk digests with the bytes that each covers; a shift of the text changes the chunks next to
an edit only.  Cuts depend on the bytes around them and on nothing else, so that a passage has the same chunks wherever
it stands; chunks are small enough for passages of some hundred bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Emitter, arrow_schema, materialize, rows

#: Least, normal and largest size of a chunk, and the zero bits that end one before and after the normal size.
LEAST, NORMAL, MOST, HARD, EASY = 8, 40, 160, 7, 4
#: Hex digits of a chunk's digest: two texts of a million chunks each share one by chance about once in two pairs.
DIGITS = 10
WINDOW = 32
BLOCK = 1 << 20
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of GEAR[byte i back] << i over the last 32 bytes, in five doublings."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            shifted = h[:-step] << np.uint32(step)
            h = h.copy()
            h[step:] += shifted
    return h


def places(whole: np.ndarray, hard: int, easy: int) -> tuple[list[int], list[int]]:
    """Where the hash has ``hard``, and where it has ``easy`` leading zero bits."""
    found: tuple[list[int], list[int]] = ([], [])
    for at in range(0, len(whole), BLOCK):
        lead = min(at, WINDOW - 1)
        h = gear_hashes(whole[at - lead : at + BLOCK])[lead:]
        e = np.nonzero(h >> np.uint32(32 - easy) == 0)[0]
        found[1].extend((e + at).tolist())
        found[0].extend((e[h[e] >> np.uint32(32 - hard) == 0] + at).tolist())
    return found


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end, ascending; empty data has none."""
    n, ends, start = len(data), [], 0
    hard, easy = places(np.frombuffer(data, np.uint8), HARD, EASY)
    while n - start > LEAST:
        i = bisect_left(hard, start + LEAST - 1)
        end = hard[i] + 1 if i < len(hard) and hard[i] + 1 < start + NORMAL else 0
        if not end:
            i = bisect_left(easy, start + NORMAL - 1)
            end = min(n, start + MOST, easy[i] + 1 if i < len(easy) else n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_set(text: str | None) -> dict[int, int]:
    """Bytes covered by each chunk digest of the text (null: empty)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out: dict[int, int] = {}
    start = 0
    for end in chunk_ends(data):
        d = xxhash.xxh64_intdigest(data[start:end]) >> (64 - 4 * DIGITS)
        out[d] = out.get(d, 0) + end - start
        start = end
    return out


def as_text(chunks: dict[int, int]) -> str:
    return ",".join(f"{d:0{DIGITS}x}:{w}" for d, w in sorted(chunks.items()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of the bytes of ``a`` that lie in chunks of ``b`` too; nothing is wholly contained in anything."""
    total = sum(a.values())
    if not total:
        return 1.0 if not b else 0.0
    return sum(min(w, b[d]) for d, w in a.items() if d in b) / total


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many of the first code points of ``following`` (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: The same as it is written: both fingerprints, which have half of their chunks in common, in one value, so that they compress together.
WRITTEN = "doc_id long, n_chars long, edited_sha256 string, fingerprints string, near_edited double, near_next double"


def _row(doc_id, text: str, own: dict[int, int], following: str, following_chunks: dict[int, int]) -> tuple:
    new = edited(text, following)
    chunks = chunk_set(new)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, f"{as_text(own)}|{as_text(chunks)}", containment(own, chunks), containment(own, following_chunks)


def fingerprint_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of FIELDS per row: fingerprints of the text and of the text edited with its successor's beginning.

    The successor is the next row by descending key (null keys last, equal keys by text); that of the
    last row is the first.  Null texts are empty; an empty text has an empty fingerprint; one row alone
    is its own successor.  Other columns are ignored; an empty table gives an empty result.
    The texts are range-partitioned by key once.  A partition streams through a task that holds one row
    back; its last row meets the first row of the next partition in a table of two rows a partition.
    """
    kinds = dict(doc_id=pa.int64(), n_chars=pa.int64(), edited_sha256=pa.string(), fingerprints=pa.string())
    kinds |= dict(near_edited=pa.float64(), near_next=pa.float64())
    ends = dict(part=pa.int32(), end=pa.string(), text=pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, held, part = Emitter(arrow_schema(**kinds, **ends), 512), None, TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, t in zip(*rows(batch, "doc_id", "text"), strict=True):
                t = t or ""
                chunks = chunk_set(t)
                if held is None:
                    e.add(doc_id, *[None] * 5, part, "first", t)
                else:
                    e.add(*_row(*held, t, chunks), None, None, None)
                held = (doc_id, t, chunks)
                if e.full():
                    yield e.take()
        if held is not None:
            e.add(held[0], *[None] * 5, part, "last", held[1])
        yield e.take()

    order = F.col("doc_id").desc_nulls_last()
    placed = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(order).sortWithinPartitions(order, F.col("text"))
    found = materialize(placed.mapInArrow(run, f"{WRITTEN}, part int, end string, text string"), "cdc")
    both = F.split("fingerprints", r"\|")
    told = lambda df: df.select("doc_id", "n_chars", "edited_sha256", both[0].alias("fingerprint"), both[1].alias("edited_fingerprint"), "near_edited", "near_next")
    inner = told(found.where("end is null"))
    parts = [r.part for r in found.where("end = 'first'").select("part").orderBy("part").collect()]  # one number a partition
    if not parts:
        return inner
    follows = dict(zip(parts, [*parts[1:], parts[0]], strict=True))
    spark = df.sparkSession
    links = spark.createDataFrame(list(follows.items()), "part int, next int")
    last = found.where("end = 'last'").select("part", "doc_id", "text").join(links, "part")
    first = found.where("end = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))

    def seam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Emitter(arrow_schema(**kinds), 64)
        for batch in batches:
            for doc_id, t, following in zip(*rows(batch, "doc_id", "text", "following"), strict=True):
                e.add(*_row(doc_id, t, chunk_set(t), following, chunk_set(following)))
        yield e.take()

    return inner.unionByName(told(last.join(first, "next").select("doc_id", "text", "following").mapInArrow(seam, WRITTEN)))
