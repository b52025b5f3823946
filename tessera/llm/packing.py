"""Packing by optimal length buckets.

One pass counts the tokens (words) of every document; the global histogram of lengths goes to the
driver, dynamic programming places the bucket boundaries so that padding is minimal, and token-budget
batches are formed inside each bucket.  The histogram has a row for each length that occurs.  Distinct
lengths add up to no more than all tokens, so there are at most sqrt(2 * tokens) of them: 6 million
rows of two numbers for 100 TB, at the very worst.  Ranks inside a bucket come from hash bins
(counts per bin, summed over the bins, plus a row number inside the bin), so that a bucket with a
third of all rows is never sorted in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_name, word_count

N_BUCKETS = 16
TOKEN_BUDGET = 16384
BIN_DIGITS = 3


def optimal_boundaries(lengths, counts, totals, n_buckets: int = N_BUCKETS) -> list[int]:
    """Upper ends of at most ``n_buckets`` buckets that minimise the padding, by dynamic programming.

    ``lengths``: ascending; ``counts``: texts of each length; ``totals``: their tokens.
    cost(i, j) = lengths[j] * texts(i..j) - tokens(i..j).  The best split moves monotonically, so each
    layer is solved by divide and conquer in O(m log m) steps of vectorised minima.
    """
    m = len(lengths)
    if not m:
        return []
    top = np.asarray(lengths, dtype=np.float64)
    c = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    t = np.concatenate([[0.0], np.cumsum(np.asarray(totals, dtype=np.float64))])
    best = top * c[1:] - t[1:]
    layers = []
    for _ in range(min(n_buckets, m) - 1):
        new, arg = best.copy(), np.full(m, -1)
        work = [(0, m - 1, 0, m - 1)]
        while work:
            lo, hi, a, b = work.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            b2 = min(b, j - 1)
            at = min(a, max(j - 1, 0))
            if b2 >= a:
                i = np.arange(a, b2 + 1)
                cost = best[i] + top[j] * (c[j + 1] - c[i + 1]) - (t[j + 1] - t[i + 1])
                k = int(np.argmin(cost))
                at = a + k
                if cost[k] < new[j]:
                    new[j], arg[j] = cost[k], at
            work += [(lo, j - 1, a, at), (j + 1, hi, at, b)]
        layers.append(arg)
        best = new
    ends, j = [], m - 1
    for arg in reversed(layers):
        if j < 0:
            break
        if arg[j] >= 0:
            ends.append(j)
            j = int(arg[j])
    ends.append(j)
    return [int(lengths[j]) for j in sorted(set(ends))]


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row per input row: (doc_id, n_tokens, bucket, bucket_tokens, batch, slot, batch_rows).

    ``bucket_tokens`` is the length to which the bucket pads; a batch holds as many rows as fit into the
    token budget at that length, one at least (a text longer than the budget is a batch of its own).
    Batches are numbered inside their bucket; the last of a bucket may be short.  Null texts have 0
    tokens and are packed too; rows that repeat a key are packed each; other columns are ignored.  An
    empty table gives an empty result.
    """
    rank = row_name(F.col(key), F.col(text), "pack")
    sized = materialize(df.select(F.col(key).alias("doc_id"), word_count(F.col(text)).alias("n_tokens"), rank.alias("rank")), "pack")
    histogram = sized.groupBy("n_tokens").count().orderBy("n_tokens").toPandas()  # at most sqrt(2 * tokens) rows
    lengths, counts = (histogram[c].to_numpy(np.int64) for c in ("n_tokens", "count"))
    ends = optimal_boundaries(lengths, counts, lengths * counts, n_buckets) or [0]
    bounds = F.array(*[F.lit(e).cast("long") for e in ends])
    bucket = F.size(F.filter(bounds, lambda e: e < F.col("n_tokens")))
    placed = (
        sized.withColumn("bucket", bucket)
        .withColumn("bucket_tokens", F.element_at(bounds, F.col("bucket") + 1))
        .withColumn("bin", F.substring("rank", 1, BIN_DIGITS))
    )
    bins = placed.groupBy("bucket", "bin").agg(F.count("*").alias("n"))
    by_bin = Window.partitionBy("bucket").orderBy("bin")
    starts = bins.select("bucket", "bin", (F.sum("n").over(by_bin) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy("bucket")).alias("rows"))
    inside = Window.partitionBy("bucket", "bin").orderBy("rank", "doc_id", "n_tokens")
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("long")
    return (
        placed.withColumn("i", F.row_number().over(inside))
        .join(starts, ["bucket", "bin"])
        .withColumn("at", F.col("start") + F.col("i") - 1)
        .withColumn("per", per_batch)
        .withColumn("batch", F.floor(F.col("at") / F.col("per")).cast("long"))
        .select(
            "doc_id",
            "n_tokens",
            F.col("bucket").cast("int").alias("bucket"),
            "bucket_tokens",
            "batch",
            (F.col("at") % F.col("per")).alias("slot"),
            F.least(F.col("per"), F.col("rows") - F.col("batch") * F.col("per")).alias("batch_rows"),
        )
    )
