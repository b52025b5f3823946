"""SimHash fingerprints and near-duplicate groups by the generalised pigeonhole principle.

Bits of a fingerprint are grouped into partitions (correlated bits together) and every partition p
gets a threshold t_p of its own, -1 meaning "not probed".  If the sum of (t_p + 1) exceeds tau, any two
fingerprints within tau differ by at most t_p in some partition.  Dynamic programming chooses the
thresholds that minimise the estimated number of candidates plus probe rows.  Both sides of a pair
probe a ball of radius t_p / 2, so they meet in a bucket; a bucket is read as a sorted run and each
pair in it is verified on the whole fingerprint, without emitting all pairs of a large bucket.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, groupby
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import linked_components
from .common import Emitter, arrow_schema, materialize, rows

SEED = 42
SAMPLE = 2048
#: Runs up to this length are compared pair by pair in vectorised form; longer ones tile by tile.
SHORT_RUN = 32
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def shingle_hashes(text: str | None, k: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every k-word shingle (repeats included) of the text in lower-case A-Z; fewer words: one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: len(words) - k]])
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def simhash(hashes: np.ndarray, words: int = 1) -> list[int]:
    """The fingerprint as ``words`` 64-bit integers; a bit is 1 if over half of the hashes have it.

    Further words come from the same hashes through fixed odd multipliers and a shift.
    """
    out = []
    for w in range(words):
        if not len(hashes):
            out.append(0)
            continue
        h = hashes
        if w:
            with np.errstate(over="ignore"):
                h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX[w % 4] + 2 * (w // 4))
                h ^= h >> np.uint64(29)
                h = h * np.uint64(MIX[(w + 1) % 4])
                h ^= h >> np.uint64(32)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 255 * 256):
            bits = np.unpackbits(h[at : at + 255 * 256].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255
            if whole:
                ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            ones += bits[whole:].sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, k: int, words: int = 1, key: str = "doc_id", text: str = "text", distinct: bool = False) -> DataFrame:
    """(doc_id, digest, n_shingles, f0, f1, ...) per row; ``digest`` is the MD5 of the text (null: of the empty text).

    ``distinct``: a shingle counts once however often the text repeats it.
    """
    out = arrow_schema(doc_id=pa.int64(), digest=pa.string(), n_shingles=pa.int64(), **{f"f{i}": pa.int64() for i in range(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Emitter(out)
        for batch in batches:
            for i, t in zip(*rows(batch, "doc_id", "text"), strict=True):
                h = shingle_hashes(t, k)
                h = np.unique(h) if distinct else h
                e.add(i, hashlib.md5((t or "").encode("utf-8", "surrogatepass")).hexdigest(), len(h), *map(signed, simhash(h, words)))
                if e.full():
                    yield e.take()
        yield e.take()

    ddl = "doc_id long, digest string, n_shingles long, " + ", ".join(f"f{i} long" for i in range(words))
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ddl)


# --- partitions and thresholds ---------------------------------------------------------------------


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of about equal size that hold bits correlated with each other."""
    width = bits.shape[1]
    x = bits.astype(np.float64)
    x -= x.mean(axis=0) if len(x) else 0.0
    norm = np.sqrt((x * x).sum(axis=0))
    corr = np.abs(x.T @ x) / np.maximum(np.outer(norm, norm), 1e-9) if len(x) else np.zeros((width, width))
    np.fill_diagonal(corr, 0)
    left, out = list(range(width)), []
    for g in range(m):
        size = len(left) // (m - g)
        group = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: corr[b, group].sum()))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def ball(width: int, threshold: int) -> int:
    """Probe rows of a partition: the ball of radius threshold / 2, on both sides of a pair."""
    return 0 if threshold < 0 else sum(comb(width, r) for r in range(-(-threshold // 2) + 1))


def allocate(bits: np.ndarray, groups: list[list[int]], n: int, tau: int, allowed=(-1, 0, 2, 4)) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) >= tau + 1 of least cost, by dynamic programming over the partitions.

    Cost of a partition: pairs of the ``n`` fingerprints that it would make candidates (share of sample
    pairs within t, at least that of random bits) and 8 times its probe rows.
    """
    need = tau + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        x = bits[:512, group].astype(np.float32)
        gap = x @ (1 - x.T) + (1 - x) @ x.T if len(x) > 1 else np.full((2, 2), len(group), np.float32)
        upper = gap[np.triu_indices(len(gap), 1)]
        new: dict[int, tuple[float, list[int]]] = {}
        for t in allowed:
            if t >= len(group):
                continue
            share = max(float((upper <= t).mean()) if t >= 0 else 0.0, sum(comb(len(group), r) for r in range(t + 1)) / 2.0 ** len(group))
            cost = 0.0 if t < 0 else n * (n / 2) * share + 8.0 * n * ball(len(group), t)
            for got, (c, ts) in best.items():
                to = min(need, got + t + 1)
                if to not in new or c + cost < new[to][0]:
                    new[to] = (c + cost, [*ts, t])
        best = new
    return best.get(need, (float("inf"), []))


def plan_partitions(bits: np.ndarray, n: int, tau: int, counts) -> list[tuple[list[int], int]]:
    """The cheapest plan over the numbers of partitions in ``counts``: (bits, threshold) of each probed partition."""
    plans = [(*allocate(bits, g, n, tau), g) for g in (group_bits(bits, m) for m in counts)]
    cost, thresholds, groups = min(plans, key=lambda p: p[0])
    return [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]


def probe_masks(group: list[int], threshold: int, words: int) -> list[tuple[int, ...]]:
    """What is flipped for each probe of a partition, as 64-bit words."""
    out = []
    for r in range(-(-threshold // 2) + 1):
        for flip in combinations(group, r):
            m = [0] * words
            for b in flip:
                m[b // 64] |= 1 << (b % 64)
            out.append(tuple(map(signed, m)))
    return out


def probed(p: int, value: list[Column]):
    return lambda flip: F.xxhash64(F.lit(p), *[v.bitwiseXOR(flip[w]) for w, v in enumerate(value)])


def bucket_keys(plan: list[tuple[list[int], int]], words: int) -> Column:
    """Array of the bucket keys of a fingerprint: a hash of the partition's number and its probed value."""
    keys = []
    for p, (group, t) in enumerate(plan):
        mask = [0] * words
        for b in group:
            mask[b // 64] |= 1 << (b % 64)
        value = [F.col(f"f{w}").bitwiseAND(F.lit(signed(mask[w]))) for w in range(words)]
        flips = F.array(*[F.array(*[F.lit(x).cast("long") for x in f]) for f in probe_masks(group, t, words)])
        keys.append(F.transform(flips, probed(p, value)))
    return F.concat(*keys)


# --- buckets ----------------------------------------------------------------------------------------


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits, over the last axis of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Forest:
    """Union-find over any values; ``join`` says whether an edge has connected what was apart.

    Beyond ``limit`` values it starts anew, which only lets more edges through.
    """

    def __init__(self, limit: int = 300_000):
        self.up: dict = {}
        self.limit = limit

    def find(self, x):
        up = self.up
        while (above := up.get(x, x)) != x:
            up[x] = up.get(above, above)
            x = above
        return x

    def join(self, a, b) -> bool:
        if len(self.up) > self.limit:
            self.up.clear()
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def tile_groups(fps: np.ndarray, tau: int, label: np.ndarray | None = None, tile: int = 512) -> list[tuple[int, int]]:
    """Edges that connect just what links of at most ``tau`` bits connect: at most one per row.

    Rows of equal ``label`` are connected already and get no edge between each other.
    """
    root = np.arange(len(fps)) if label is None else np.unique(label, return_index=True)[1][np.unique(label, return_inverse=True)[1]]
    forest, out = Forest(2 * len(fps)), []
    for a in range(0, len(fps), tile):
        for b in range(0, a + 1, tile):
            if label is not None and (root[a : a + tile].min() == root[a : a + tile].max() == root[b : b + tile].min() == root[b : b + tile].max()):
                continue
            i, j = np.nonzero(distances(fps[a : a + tile, None], fps[None, b : b + tile]) <= tau)
            pairs = np.unique(np.stack([root[i + a], root[j + b]], 1), axis=0)
            new = [(x, y) for x, y in pairs[pairs[:, 0] != pairs[:, 1]].tolist() if forest.join(x, y)]
            if new:
                out += new
                to = np.arange(len(fps))
                for x in {x for pair in new for x in pair} | set(forest.up):
                    to[x] = forest.find(x)
                root = to[root]
    return out


def bucket_links(keyed: DataFrame, words: int, tau: int) -> DataFrame:
    """Links (a0, .., b0, ..) between fingerprints of equal ``key`` within ``tau``, from rows sorted by key.

    ``keyed``: (key, label, f0, ..); rows of equal label are connected already.  The links connect what all
    links connect: a short run is compared pair by pair, a longer one tile by tile, and a task passes on the
    links that connect what it has not connected yet.  Memory: one batch, one run and a bounded forest.
    """
    names = [f"{s}{w}" for s in "ab" for w in range(words)]
    out = arrow_schema(**{n: pa.int64() for n in names})

    def links(key: np.ndarray, label: np.ndarray, fps: np.ndarray) -> np.ndarray:
        """Rows (label, fingerprint) of both ends of the links of whole runs."""
        start = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
        length = np.diff(np.concatenate([start, [len(key)]]))
        run = np.repeat(np.arange(len(start)), length)
        short = length[run] <= SHORT_RUN
        left, right = [], []
        for lag in range(1, min(SHORT_RUN, int(length.max()))):
            i = np.nonzero(short[:-lag] & (run[lag:] == run[:-lag]))[0]
            if not len(i):
                break
            i = i[label[i] != label[i + lag]]
            i = i[distances(fps[i], fps[i + lag]) <= tau]
            left.append(i)
            right.append(i + lag)
        for r in np.nonzero(length > SHORT_RUN)[0].tolist():
            own = slice(start[r], start[r] + length[r])
            found = np.array(tile_groups(fps[own], tau, label[own]), np.int64).reshape(-1, 2) + start[r]
            left.append(found[:, 0])
            right.append(found[:, 1])
        i, j = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (left, right))
        return np.column_stack([label[i], label[j], fps[i].view(np.int64), fps[j].view(np.int64)])

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        forest = Forest()

        def done(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            pairs = np.unique(links(*(np.concatenate([p[k] for p in parts]) for k in range(3))), axis=0)
            new = [forest.join(a, b) for a, b in pairs[:, :2].tolist()]
            pairs = np.ascontiguousarray(pairs[np.array(new, bool), 2:]) if new else pairs[:0, 2:]
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c])) for c in range(2 * words)], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            fps = np.stack([batch.column(2 + w).to_numpy(zero_copy_only=False).view(np.uint64) for w in range(words)], 1)
            cut = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            if cut:
                yield from done([*held, (key[:cut], label[:cut], fps[:cut])])
                held = [(key[cut:], label[cut:], fps[cut:])]
            elif held and held[-1][0][-1] != key[0]:
                yield from done(held)
                held = [(key, label, fps)]
            else:
                held.append((key, label, fps))
        if held:
            yield from done(held)

    fields = ["key", "label", *[f"f{w}" for w in range(words)]]
    sorted_rows = keyed.select(*fields).repartition("key").sortWithinPartitions("key")
    return sorted_rows.mapInArrow(run_all, ", ".join(f"{n} long" for n in names)).distinct()


def fingerprint_links(prints: DataFrame, words: int, tau: int, counts, plan_tau: int | None = None, probed: int | None = None) -> DataFrame:
    """Links that connect what links within ``tau`` among the distinct fingerprints (f0, ..) of ``prints`` connect.

    ``plan_tau``, ``probed``: the plan finds for certain what differs by at most ``plan_tau`` of the first ``probed`` bits,
    and of the rest what it meets (default: ``tau`` of all bits, which finds all).

    If the plan probes balls, the partitions are probed exactly first; fingerprints that this connects have
    one label and need no further links between each other, so that a large group of near copies does not
    meet in every ball again.  The sample for the plan (at most SAMPLE fingerprints, lowest hash first)
    only steers the cost.
    """
    names = [f"f{w}" for w in range(words)]
    distinct = materialize(prints.select(*names).distinct(), "fp")
    n = distinct.count()
    sample = [[v & (2**64 - 1) for v in r] for r in distinct.orderBy(F.xxhash64(*names), *names).limit(SAMPLE).collect()]
    as_words = np.array(sample, np.uint64).reshape(-1, words)
    bits = np.unpackbits(as_words.astype("<u8").view(np.uint8).reshape(len(as_words), 8 * words), axis=1, bitorder="little") if len(as_words) else np.zeros((0, 64 * words), np.uint8)
    plan = plan_partitions(bits[:, :probed], max(n, 1), tau if plan_tau is None else plan_tau, counts)
    own = F.xxhash64(F.lit("label"), *names)
    exact = distinct.select(F.explode(bucket_keys([(g, 0) for g, _ in plan], words)).alias("key"), own.alias("label"), *names)
    links = bucket_links(exact, words, tau)
    if all(t == 0 for _, t in plan):
        return links
    links = materialize(links, "exact")
    end = lambda side: F.xxhash64(F.lit("label"), *[f"{side}{w}" for w in range(words)])
    comp = linked_components(links.select(end("a").alias("a"), end("b").alias("b")), "a", "b")
    labelled = distinct.withColumn("node", own).join(comp, "node", "left").withColumn("label", F.coalesce("component", "node"))
    keyed = labelled.select(F.explode(bucket_keys(plan, words)).alias("key"), "label", *names)
    return links.unionByName(bucket_links(keyed, words, tau))


def simhash_groups(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, tau: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: groups of rows whose 64-bit fingerprints link.

    Fingerprints within ``tau`` bits link, and links are followed to the end; the component is named by
    its smallest doc_id.  Null and empty texts have fingerprint zero and link like any other.  Rows that
    repeat a doc_id or a text count each; null doc_ids never name a component unless it has no other.
    Other columns are ignored.  An empty table gives an empty result.  Exact for every pair.
    """
    prints = materialize(fingerprints(df, k, 1, key, text).select("doc_id", "f0"), "prints")
    links = fingerprint_links(prints, 1, tau, range(1, tau + 2))
    comp = linked_components(links, "a0", "b0").select(F.col("node").alias("f0"), "component")
    first = prints.groupBy("f0").agg(F.min("doc_id").alias("low")).join(comp, "f0", "left")
    first = first.withColumn("group", F.coalesce("component", "f0"))
    lowest = first.groupBy("group").agg(F.min("low").alias("component_id"))
    named = first.select("f0", "group").join(lowest, "group").select("f0", "component_id")
    return prints.join(named, "f0").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


# --- near-duplicate texts ---------------------------------------------------------------------------

#: Production parameters of ``near_duplicates``: five-word shingles, Jaccard 0.8, 192-bit fingerprints of which 128 are probed.
SHINGLE_WORDS, SIMILARITY, NEAR_WORDS, PROBED_BITS = 5, 0.8, 3, 128
#: Differing bits of candidates, of 192 (similarity 0.8 lies near 29, unrelated texts near 96); bits of the probed 128
#: within which a candidate is found for certain (0.8: near 19); numbers of partitions to choose from.
NEAR_TAU, NEAR_GUARANTEED, NEAR_PARTITIONS = 45, 20, (5, 6, 7)
#: Texts of a cluster that are compared in one task; of a larger cluster all texts are compared with so many of them first.
CLUSTER_BLOCK, PIVOTS = 512, 16


def near_duplicates(df: DataFrame) -> DataFrame:
    """(doc_id, digest, kept, group_id) per distinct (doc_id, text): groups of texts of Jaccard similarity 0.8 or more.

    Copies of a text group by MD5 (null is an empty text).  Between distinct texts, SimHash fingerprints of the
    distinct five-word shingles find candidates: for certain within NEAR_GUARANTEED of the probed bits, and
    where any partition of them is close enough, which at similarity 0.8 holds for 98 of 100 pairs, at 0.85
    for all but one in 2000.  Candidates form loose clusters, inside which the shingle sets of all texts, of any
    length, are compared exactly; groups are what these exact links connect.  One row of each group is
    kept: the smallest doc_id (null last), ties by digest.  Other columns are ignored; an empty table gives an
    empty result.
    """
    prints = materialize(fingerprints(df, SHINGLE_WORDS, NEAR_WORDS, distinct=True), "near")
    # (a text of fewer than SHINGLE_WORDS words is one shingle: near copies of it are exact copies)
    names = [f"f{w}" for w in range(NEAR_WORDS)]
    by_text = materialize(prints.groupBy("digest", *names).agg(F.min("doc_id").alias("low")), "texts")
    lead = by_text.groupBy(*names).agg(F.min("digest").alias("lead"))
    inner = by_text.join(lead, names).where("digest <> lead").select(F.col("digest").alias("a"), F.col("lead").alias("b"))
    links = fingerprint_links(by_text, NEAR_WORDS, NEAR_TAU, NEAR_PARTITIONS, NEAR_GUARANTEED, PROBED_BITS)
    ends = {side: [f"{side}{w}" for w in range(NEAR_WORDS)] for side in "ab"}
    left, right = lead.toDF(*ends["a"], "a"), lead.toDF(*ends["b"], "b")
    outer = links.join(left, ends["a"]).join(right, ends["b"]).select("a", "b")
    clusters = linked_components(outer.unionByName(inner), "a", "b").select(F.col("node").alias("digest"), F.col("component").alias("cluster"))
    edges = exact_links(df, by_text, clusters)
    comp = linked_components(edges, "a", "b").select(F.col("node").alias("digest"), "component")
    grouped = prints.select("doc_id", "digest").distinct().join(comp, "digest", "left").withColumn("group_id", F.coalesce("component", "digest"))
    best = grouped.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("best"))
    return grouped.join(best, "group_id").select(
        "doc_id", "digest", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))).alias("kept"), "group_id"
    )


def similar_pairs(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Which sets (rows) are similar to which: a matrix of truth, for the sets before ``split`` against all from it on, or all if it is 0."""
    size = np.array([len(x) for x in sets], np.float64)
    n = len(sets)
    flat = np.concatenate(sets) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), size.astype(np.int64))
    _, name, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[name] > 1  # a shingle of one text adds nothing to an intersection
    known, name = np.unique(name[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(name, kind="stable")
    name, owner = name[order], owner[order]
    rows_ = n if not split else split
    both = np.zeros((rows_, n if not split else n - split), np.float32)
    for at in range(0, len(known), 8192):
        lo, hi = np.searchsorted(name, [at, at + 8192])
        m = np.zeros((n, min(8192, len(known) - at)), np.float32)
        m[owner[lo:hi], name[lo:hi] - at] = 1
        both += m[:rows_] @ (m if not split else m[split:]).T
    other = size if not split else size[split:]
    union = size[:rows_, None] + other[None] - both
    return (both >= SIMILARITY * union) & (union > 0)


def exact_links(df: DataFrame, by_text: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links (a, b) of digests that connect just what links of Jaccard similarity >= SIMILARITY connect inside the clusters.

    A cluster of up to CLUSTER_BLOCK texts is one comparison.  Of a larger one, PIVOTS texts are compared with all
    first, block by block.  What they connect to one group, the largest, needs no more comparison inside; the
    blocks of the other texts are compared with each other and with those of that group.  So a group of copies
    around a common core costs as much as it has texts, not pairs.
    """
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / CLUSTER_BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    wanted = clusters.join(sizes, "cluster").withColumn("block", block).join(by_text.select("digest", "low"), "digest")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(cluster=pa.string(), blocks=pa.int32(), block=pa.int32(), digest=pa.string(), shingles=pa.binary())
        for batch in batches:
            e = Emitter(out, 256)
            for c, n, b, d, t in zip(*rows(batch, "cluster", "blocks", "block", "digest", "text"), strict=True):
                e.add(c, n, b, d, np.unique(shingle_hashes(t, SHINGLE_WORDS)).tobytes())
                if e.full():
                    yield e.take()
            yield e.take()

    texts = df.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(wanted.withColumnRenamed("low", "_low"), F.col("_id").eqNullSafe(F.col("_low")) & (F.md5("text") == F.col("digest")))
    texts = texts.dropDuplicates(["digest"]).select("cluster", "blocks", "block", "digest", "text")
    packed = materialize(texts.mapInArrow(pack, "cluster string, blocks int, block int, digest string, shingles binary"), "sets")
    units = packed.select("cluster", F.lit(0).alias("u"), F.lit(1).alias("rest"), F.lit(1).alias("units"), "digest", "shingles")
    stars = None
    if not packed.where("blocks > 1").isEmpty():
        stars = materialize(pivot_links(packed.where("blocks > 1")), "stars")
        units = units.join(stars.select("cluster").distinct(), "cluster", "left_anti").unionByName(unresolved(packed, stars))
    # a unit is a block of texts; pairs of units (a, b) with a <= b, of which the first is not among those connected
    ahead = units.where("u < rest").select("cluster", F.col("u").alias("a"), F.explode(F.sequence("u", F.col("units") - 1)).alias("b"), F.lit(0).alias("side"), "digest", "shingles")
    behind = units.where("u > 0 and rest > 0").select("cluster", F.explode(F.sequence(F.lit(0), F.least("u", "rest") - 1)).alias("a"), F.col("u").alias("b"), F.lit(1).alias("side"), "digest", "shingles")
    keys = ["cluster", "a", "b"]
    placed = ahead.unionByName(behind).repartition(*keys).sortWithinPartitions(*keys, "side", "digest")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Emitter(arrow_schema(a=pa.string(), b=pa.string()))
        key, held = None, []

        def done() -> None:
            split = sum(1 for h in held if h[0] == 0) if key[1] != key[2] else 0
            if len(held) < 2 or split == len(held):
                return
            i, j = np.nonzero(similar_pairs([np.frombuffer(h[2], np.uint64) for h in held], split))
            links = np.zeros((len(held), len(held)), bool)
            links[i, j + split] = True
            for x, y in spanning(links | links.T):
                e.add(held[x][1], held[y][1])

        for batch in batches:
            for *k, side, digest, shingles in zip(*rows(batch, *keys, "side", "digest", "shingles"), strict=True):
                if k != key:
                    if held:
                        done()
                    key, held = k, []
                held.append((side, digest, shingles))
            if e.full():
                yield e.take()
        if held:
            done()
        yield e.take()

    found = placed.mapInArrow(compare, "a string, b string")
    if stars is None:
        return found
    return found.unionByName(stars.select(F.col("digest").alias("a"), F.explode("linked").alias("b")).where("a <> b"))


def pivot_links(packed: DataFrame) -> DataFrame:
    """(cluster, digest, linked): for each text of ``packed`` the pivots of its cluster that it is similar to."""
    place = F.xxhash64(F.lit("pivot"), "digest")
    lots = [F.min_by(F.struct("digest", "shingles"), F.when(F.pmod(place, F.lit(PIVOTS)) == k, place)).alias(f"p{k}") for k in range(PIVOTS)]
    chosen = packed.groupBy("cluster", "blocks").agg(*lots)
    chosen = chosen.select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.explode(F.array_compact(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("p"))
    rows_ = chosen.select("cluster", "block", F.lit(0).alias("side"), "p.digest", "p.shingles")
    rows_ = rows_.unionByName(packed.select("cluster", "block", F.lit(1).alias("side"), "digest", "shingles"))
    placed = rows_.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "side", "digest")
    schema = arrow_schema(cluster=pa.string(), digest=pa.string(), linked=pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for batch in batches for row in zip(*rows(batch, "cluster", "block", "side", "digest", "shingles"), strict=True))
        e = Emitter(schema)
        for _, group in groupby(flat, key=lambda r: r[:2]):
            held = list(group)  # a block and the pivots
            split = sum(r[2] == 0 for r in held)
            near = similar_pairs([np.frombuffer(r[4], np.uint64) for r in held], split)
            for j, (cluster, _, _, digest, _) in enumerate(held[split:]):
                e.add(cluster, digest, [held[i][3] for i in np.nonzero(near[:, j])[0].tolist()])
            if e.full():
                yield e.take()
        yield e.take()

    return placed.mapInArrow(run, "cluster string, digest string, linked array<string>")


def unresolved(packed: DataFrame, stars: DataFrame) -> DataFrame:
    """The units (cluster, u, rest, units, digest, shingles) of the clusters in ``stars``: units from ``rest`` on hold the texts
    that pivots have connected to the largest group, the ones before it all others."""
    ties = stars.where("size(linked) > 0").groupBy("cluster", "linked").agg(F.count("*").alias("n"))  # pivots that a text links belong together

    def largest(pdf: pd.DataFrame) -> pd.DataFrame:
        forest, weight = Forest(), Counter()
        for linked in pdf["linked"]:
            for other in linked[1:]:
                forest.join(linked[0], other)
        for linked, n in zip(pdf["linked"], pdf["n"], strict=True):
            weight[forest.find(linked[0])] += n
        best = min(weight, key=lambda x: (-weight[x], x))
        return pd.DataFrame([(pdf["cluster"].iloc[0], [p for p in {p for linked in pdf["linked"] for p in linked} if forest.find(p) == best])], columns=["cluster", "main"])

    # at most 2 ** PIVOTS rows of a cluster, a few in practice
    main = ties.groupBy("cluster").applyInPandas(largest, "cluster string, main array<string>")
    marked = stars.join(main, "cluster", "left").select("cluster", "digest", F.coalesce(F.arrays_overlap("linked", "main"), F.lit(False)).alias("done"))
    many = lambda done: F.ceil(F.count_if(F.col("done") == done) / CLUSTER_BLOCK).cast("int")
    sizes = marked.groupBy("cluster").agg(many(False).alias("rest"), many(True).alias("grouped"))
    lot = lambda n: F.pmod(F.xxhash64("digest"), n).cast("int")
    unit = F.when(F.col("done"), F.col("rest") + lot(F.greatest(F.col("grouped"), F.lit(1)))).otherwise(lot(F.greatest(F.col("rest"), F.lit(1))))
    told = marked.join(sizes, "cluster").select("digest", unit.alias("u"), "rest", (F.col("rest") + F.col("grouped")).alias("units"))
    return packed.select("cluster", "digest", "shingles").join(told, "digest").select("cluster", "u", "rest", "units", "digest", "shingles")


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """A tree over each connected component of a symmetric matrix of links: (row, row found before it)."""
    left, out = np.ones(len(links), bool), []
    for start in range(len(links)):
        if not left[start]:
            continue
        left[start] = False
        stack = [start]
        while stack:
            x = stack.pop()
            new = np.nonzero(links[x] & left)[0]
            left[new] = False
            out += [(int(y), x) for y in new]
            stack += new.tolist()
    return out
