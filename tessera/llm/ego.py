"""Embedding near-dedup by an epsilon grid order join.

Vectors of unit length are at most EPSILON apart if their cosine is at least the threshold.  Equal
vectors are one vector with a count.  The distinct ones are sorted by the grid cells (of side EPSILON)
of their leading principal coordinates, and the sorted sequence is cut into blocks of bounded size.

The join recurses over intervals of the sequence.  Intervals of FAN blocks, of FAN such intervals and so
on form a tree with bounding boxes; beginning with the whole sequence against itself, every level
splits the pairs that are left into pairs of parts and leaves out those that are provably further
apart than EPSILON in all the leading directions together.  A level is a join on interval numbers, so
no cell and no dense region is a key.  What is left of blocks is dealt in tiles of TILE x TILE blocks,
each block once to a tile; inside, the recursion goes on down to LEAF vectors, which a product of
matrices in double precision compares.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import linked_components
from .common import materialize

THRESHOLD = 0.9
#: Rows used to find the principal directions; they steer the pruning only, every row is joined.
SAMPLE = 4096
#: Principal coordinates in the order and in the bounding boxes.
ORDER_DIMS, BOX_DIMS = 4, 16
#: Bytes of a block in double precision, vectors of a leaf, children of an interval, blocks of a side of a tile.
BLOCK_BYTES, LEAF, FAN, TILE = 1 << 20, 256, 64, 8
#: Boxes of vectors of different lengths are as far apart as this, which is further than unit vectors can be.
APART = 4.0


def units(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (rows that link, their unit vectors): not null, of finite components, not all zero."""
    lengths: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v) and None not in v:
            lengths.setdefault(len(v), []).append(i)
    out = {}
    for d, good in lengths.items():
        rows, x = np.array(good, np.int64), np.array([vectors[i] for i in good], np.float64)
        fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        out[d] = rows[fine], normed(x[fine])
    return out


def normed(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, initial=0.0)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def principal_axes(sample: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` leading principal directions as columns (about the origin of the sample's mean)."""
    if len(sample) < 2:
        return np.eye(sample.shape[1])[:, :k]
    x = sample - sample.mean(axis=0)
    return np.linalg.svd(x, full_matrices=False)[2][:k].T if len(x) >= k else np.eye(sample.shape[1])[:, :k]


class Axes:
    """Directions by the length of vectors: principal ones for the usual length, else the first coordinates."""

    def __init__(self, usual: int, axes: np.ndarray):
        self.usual, self.axes = usual, axes

    def of(self, d: int) -> np.ndarray:
        return self.axes if d == self.usual else np.eye(d)[:, : min(BOX_DIMS, d)]

    def cells(self, x: np.ndarray, epsilon: float) -> np.ndarray:
        out = np.zeros((len(x), ORDER_DIMS), np.int32)
        k = min(ORDER_DIMS, x.shape[1])
        out[:, :k] = np.floor(x @ self.of(x.shape[1])[:, :k] / epsilon)
        return out

    def box(self, x: np.ndarray) -> np.ndarray:
        """Lower and upper bounds; the first coordinate tells lengths apart."""
        p = x @ self.of(x.shape[1])
        out = np.zeros((2, BOX_DIMS + 1))
        out[:, 0] = APART * x.shape[1]
        out[0, 1 : p.shape[1] + 1], out[1, 1 : p.shape[1] + 1] = p.min(axis=0), p.max(axis=0)
        return out


def near_boxes(a: np.ndarray, b: np.ndarray, far: float) -> np.ndarray:
    """Which boxes (n, 2, dims) come within a squared distance of ``far``: a matrix of truth."""
    gap = np.maximum(0.0, np.maximum(a[:, None, 0] - b[None, :, 1], b[None, :, 0] - a[:, None, 1]))
    return np.einsum("ijk,ijk->ij", gap, gap) <= far


class Groups:
    """Union-find over rows, with the roots of all rows at hand as an array."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        pairs = np.unique(np.stack([self.root[i], self.root[j]], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]].tolist()
        if not pairs:
            return
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        to = np.arange(len(self.root))
        for x in list(up):
            to[x] = find(x)
        self.root = to[self.root]


class Joiner:
    """Links between the vectors of a tile: how many each has (copies counted) and what they connect."""

    def __init__(self, vectors: np.ndarray, counts: np.ndarray, axes: np.ndarray, threshold: float):
        self.vectors, self.counts, self.threshold = vectors, counts, threshold
        self.far = 2 - 2 * threshold + 1e-9
        self.place = vectors @ axes
        self.links, self.groups = np.zeros(len(vectors), np.int64), Groups(len(vectors))
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (lo, hi) not in self.boxes:
            self.boxes[lo, hi] = self.place[lo:hi].min(axis=0), self.place[lo:hi].max(axis=0)
        return self.boxes[lo, hi]

    def join(self, a0: int, a1: int, b0: int, b1: int) -> None:
        """Joins two intervals that are equal or follow each other."""
        if a0 >= a1 or b0 >= b1:
            return
        (al, ah), (bl, bh) = self.box(a0, a1), self.box(b0, b1)
        gap = np.maximum(0, np.maximum(al - bh, bl - ah))
        if gap @ gap > self.far:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            i, j = np.nonzero(self.vectors[a0:a1] @ self.vectors[b0:b1].T >= self.threshold)
            i, j = i + a0, j + b0
            if a0 == b0:
                i, j = i[i < j], j[i < j]
            if len(i):
                np.add.at(self.links, i, self.counts[j])
                np.add.at(self.links, j, self.counts[i])
                self.groups.link(i, j)
            return
        am, bm = ((x0 + x1) // 2 if x1 - x0 > LEAF else x1 for x0, x1 in ((a0, a1), (b0, b1)))
        for x in ((a0, am), (am, a1)):
            for y in ((b0, bm), (bm, b1)):
                if a0 != b0 or x <= y:
                    self.join(*x, *y)


def bound(c: int) -> Column:
    """Coordinate ``c`` of the box around the boxes of ``kids``: lower bounds come first, then upper ones."""
    each = F.transform("kids", lambda k: k["box"][c])
    return F.array_min(each) if c <= BOX_DIMS else F.array_max(each)


def block_pairs(meta: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a <= b: the pairs of blocks (block, box) whose boxes may hold a link, by recursion over intervals.

    Blocks are numbered through.  A level of the tree has a row for each interval: its number and its children's
    numbers and boxes.  The number of levels is the logarithm of the number of blocks to the base FAN.
    """
    levels, nodes, n = [], meta.select(F.col("block").alias("i"), "box"), meta.count()
    while True:
        kids = nodes.groupBy(F.floor(F.col("i") / FAN).cast("long").alias("i")).agg(F.sort_array(F.collect_list(F.struct("i", "box"))).alias("kids"))  # FAN at most
        kids = materialize(kids, "level")
        levels.append(kids)
        n = -(-n // FAN)
        if n <= 1:
            break
        nodes = kids.select("i", F.array(*[bound(c) for c in range(2 * (BOX_DIMS + 1))]).alias("box"))
    far = 2 - 2 * threshold + 1e-9

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(kids: list) -> tuple[np.ndarray, np.ndarray]:
            return np.array([k["i"] for k in kids], np.int64), np.array([k["box"] for k in kids]).reshape(len(kids), 2, -1)

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (ai, abox), (bi, bbox) = side(a), side(b)
                i, j = np.nonzero(near_boxes(abox, bbox, far))
                i, j = ai[i], bi[j]
                ahead = i <= j
                yield pa.RecordBatch.from_arrays([pa.array(i[ahead]), pa.array(j[ahead])], ["a", "b"])

    pairs = levels[-1].select(F.col("i").alias("a"), F.col("i").alias("b"))  # the whole sequence against itself
    for kids in reversed(levels):
        left, right = kids.toDF("a", "kids_a"), kids.toDF("b", "kids_b")
        pairs = pairs.join(left, "a").join(right, "b").select("kids_a", "kids_b").mapInArrow(split, "a long, b long")
    return pairs


def epsilon_join(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: links of cosine >= ``threshold`` and their components.

    Null, empty or zero vectors and vectors with null or non-finite components link with nothing; vectors of
    different lengths have no cosine and don't link.  Rows that repeat a vec_id are vectors of their own and
    link like any other; null ids never name a component that has another id.  ``kept`` is vec_id =
    component_id (null ids: true only for a component without ids).  Other columns are ignored; an empty
    table gives an empty result.  Exact: every row is joined, the order only saves comparisons.
    """
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    lengths = rows.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    usual = lengths.orderBy(F.desc("n"), "d").limit(1).collect()
    dims = usual[0].d if usual else 1
    sample = rows.where(F.size("v") == dims).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    found = units([list(r.v) for r in sample]).get(dims)
    axes = Axes(dims, principal_axes(found[1] if found else np.zeros((0, dims)), min(BOX_DIMS, dims)))
    epsilon = math.sqrt(2 - 2 * threshold)
    order = [f"c{c}" for c in range(ORDER_DIMS)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cells, length = np.zeros((n, ORDER_DIMS), np.int32), np.zeros(n, np.int32)
            names: list[str | None] = [None] * n
            blobs: list[bytes | None] = [None] * n
            for d, (good, x) in units(batch.column(1).to_pylist()).items():
                cells[good], length[good] = axes.cells(x, epsilon), d
                for i, row in zip(good.tolist(), x, strict=True):
                    blobs[i] = row.tobytes()
                    names[i] = hashlib.md5(blobs[i]).hexdigest()
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(length), *[pa.array(np.ascontiguousarray(cells[:, c])) for c in range(ORDER_DIMS)]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary())], ["vec_id", "name", "d", *order, "v"])

    ddl = "vec_id long, name string, d int, " + ", ".join(f"{c} int" for c in order) + ", v binary"
    placed = materialize(rows.mapInArrow(place, ddl), "vectors")
    distinct = placed.where("name is not null").groupBy("name").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), *[F.first(c).alias(c) for c in ("d", *order, "v")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        held: list[tuple[str, int, bytes]] = []

        def block() -> pa.RecordBatch:
            nonlocal count
            x = np.frombuffer(b"".join(h[2] for h in held), np.float64).reshape(len(held), -1)
            values = [part, count, axes.box(x).ravel().tolist(), "".join(h[0] for h in held), np.array([h[1] for h in held], np.int64).tobytes(), x.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string(), pa.binary(), pa.binary()]
            count += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["part", "count", "box", "names", "counts", "vectors"])

        for batch in batches:
            for name, n, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if held and (len(v) != len(held[0][2]) or (len(held) + 1) * len(v) > BLOCK_BYTES):
                    yield block()
                held.append((name, n, v))
        if held:
            yield block()

    ordered = distinct.repartitionByRange("d", *order, "name").sortWithinPartitions("d", *order, "name").select("name", "n", "v")
    cut_up = materialize(ordered.mapInArrow(cut, "part int, count int, box array<double>, names string, counts binary, vectors binary"), "blocks")
    per_part = sorted((r.part, r.n) for r in cut_up.groupBy("part").agg(F.max("count").alias("n")).collect())  # one number a partition
    offsets, at = [], 0
    for p, last in per_part:
        offsets.append((p, at))
        at += last + 1
    starts = df.sparkSession.createDataFrame(offsets, "part int, start long")
    blocks = cut_up.join(F.broadcast(starts), "part").withColumn("block", F.col("start") + F.col("count"))  # a row a partition
    pairs = block_pairs(blocks.select("block", "box"), threshold)
    ta, tb = (F.floor(F.col(c) / TILE).cast("long") for c in "ab")
    wanted = pairs.select(ta.alias("ta"), tb.alias("tb"), F.col("a").alias("block"), F.col("b").alias("with"))
    wanted = wanted.unionByName(pairs.select(ta.alias("ta"), tb.alias("tb"), F.col("b").alias("block"), F.lit(None).cast("long").alias("with")))
    wanted = wanted.groupBy("ta", "tb", "block").agg(F.collect_list("with").alias("with"))  # at most TILE each
    tiles = wanted.join(blocks.select("block", "names", "counts", "vectors"), "block")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        number, partners, names, counts, blobs = (table.column(c).to_pylist() for c in ("block", "with", "names", "counts", "vectors"))
        own = {b: k for k, b in enumerate(number)}
        count = [np.frombuffer(c, np.int64) for c in counts]
        dims = [len(v) // 8 // len(c) for v, c in zip(blobs, count, strict=True)]
        out: dict[str, list] = {"name": [], "n": [], "root": []}
        for d in sorted(set(dims)):
            mine = [k for k in range(len(number)) if dims[k] == d]
            edge = dict(zip(mine, np.cumsum([0, *[len(count[k]) for k in mine]]).tolist(), strict=False))
            joiner = Joiner(np.frombuffer(b"".join(blobs[k] for k in mine), np.float64).reshape(-1, d), np.concatenate([count[k] for k in mine]), axes.of(d), threshold)
            for k in mine:
                for other in partners[k]:
                    j = own[other]
                    if dims[j] == d:
                        joiner.join(edge[k], edge[k] + len(count[k]), edge[j], edge[j] + len(count[j]))
            every = "".join(names[k] for k in mine)
            name = lambda i, every=every: every[32 * i : 32 * i + 32]
            hit = np.nonzero(joiner.links)[0].tolist()
            out["name"] += map(name, hit)
            out["n"] += joiner.links[hit].tolist()
            out["root"] += map(name, joiner.groups.root[hit].tolist())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), (pa.string(), pa.int64(), pa.string()), strict=True)})

    partial = materialize(tiles.groupBy("ta", "tb").applyInArrow(compare, "name string, n long, root string"), "links")
    comp = linked_components(partial.select("name", "root"), "name", "root").withColumnRenamed("node", "name")
    counts = partial.groupBy("name").agg(F.sum("n").alias("n_links"))
    whole = distinct.select("name", "n", "low").join(counts, "name", "left").join(comp, "name", "left").withColumn("component", F.coalesce("component", "name"))
    lowest = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    told = whole.join(lowest, "component").select("name", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = placed.where("name is not null").select("vec_id", "name").join(told, "name").select("vec_id", "n_links", "component_id")
    alone = placed.where("name is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
