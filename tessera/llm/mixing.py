"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key, made of its id and text.  Rows of a source are ordered by that key: the leading hex digits of
the key form bins, per-bin totals are summed over the bins of a source (a table of at most
``16 ** BIN_DIGITS`` rows for each source), and inside a bin a window gives the running sum.  Adding
both is a prefix sum over the whole source without ever sorting one source in one task.  The budget
of a source is then whole epochs plus a cut at the exact remainder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import any_order, fresh, materialize, row_name, word_count

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
BIN_DIGITS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources by code point, null last.  Targets share the total in proportion to
    the weights; a target above ``max_epochs`` times its source is set there and the excess is shared
    again.  The fixed point is the level L at which the sum of min(cap, L * weight) is the total: with
    the sources ordered by cap / weight, the capped ones are a prefix.
    The windows below run over the sources, one row each.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").isNull(), F.col("source"))
    by_level = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    total = F.sum("source_size").over(every)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", total)
        .withColumn("left_size", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.col("left_weight") <= F.col("left_size") * F.col("weight"))
    )
    first_free = lambda c: F.min_by(c, F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")))).over(every)
    return ranked.withColumn("free_size", first_free(F.col("left_size"))).withColumn("free_weight", first_free(F.col("left_weight"))).select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double"))
        .otherwise(F.col("weight") * F.col("free_size").cast("double") / F.col("free_weight").cast("double"))
        .alias("target"),
    )


def placed(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, weights=WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, rank) per row; see ``mix``."""
    rank = row_name(F.col(key), F.col(text), seed)
    sized = materialize(
        df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), rank.alias("rank")), "mix"
    ).withColumn("bin", F.substring("rank", 1, BIN_DIGITS))
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights)
    starts = bins.select(
        F.col("source").alias("s"),
        F.col("bin").alias("b"),
        (F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_size")).alias("start"),
    )
    t = targets.withColumnRenamed("source", "t")
    inside = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
        .join(t, F.col("source").eqNullSafe(F.col("t")))
        .withColumn("prefix", F.col("start") + F.col("before"))
    )
    return found.select("doc_id", "source", "size", "source_size", "target", _taken().alias("taken"), "rank")


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, weights=WEIGHTS) -> DataFrame:
    """One row per input row: (key, source, size, source_size, target, taken).

    Null texts have size 0, a null source is a source of its own (last in the order of weights), null
    keys order like the text "null".  Rows that repeat a key are told apart by their texts; rows equal in
    both follow each other and are interchangeable.  Other columns are ignored.  ``taken`` counts the words
    that the mix takes from the row: whole epochs first, then the rows up to the cut; the row at the
    cut gives just the words that are missing.  An empty table gives an empty result.
    """
    return placed(df, key, source, text, seed, weights).drop("rank")


def _taken() -> Column:
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    return (whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("prefix")))).cast("long")


def mixed(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, weights=WEIGHTS) -> DataFrame:
    """The mixed corpus: each row of ``df`` as often as ``mix`` takes it (the row at the cut stays whole).

    Rows without words are never taken.  Nulls and repeated rows count as in ``mix``: of m rows equal in
    key, source and text that the mix takes n times in all, each comes n / m times, and the first of them
    once more for the rest.  All columns, whatever their names, pass through; an empty table gives an
    empty result.
    """
    own, name, rows, times, number, turn = fresh(df, "row_name", "other_name", "rows", "times", "number", "turn")
    in_source = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    found = placed(df, key, source, text, seed, weights)
    wanted = (
        found.groupBy(F.concat("rank", in_source(F.col("source"))).alias(name))
        .agg(F.count("*").alias(rows), F.sum(F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)).alias(times))
        .where(F.col(times) > 0)
    )
    named = df.withColumn(own, F.concat(row_name(F.col(key), F.col(text), seed), in_source(F.col(source))))
    numbered = named.join(wanted, F.col(own) == F.col(name)).withColumn(number, F.row_number().over(Window.partitionBy(own).orderBy(*any_order(df))))
    each = F.floor(F.col(times) / F.col(rows)) + F.when(F.col(number) <= F.col(times) % F.col(rows), 1).otherwise(0)
    return numbered.where(each > 0).withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), each.cast("long")))).select(*[f"`{c}`" for c in df.columns])


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix-1:' || md5(coalesce(text, ''))) AS rank
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, source_size * 3 AS cap,
         sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3.0 / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size * 3.0 / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight,
         row_number() OVER (ORDER BY source_size * 3.0 / weight, source IS NULL, source) AS k
  FROM s),
c AS (SELECT *, cap * left_weight <= left_size * weight AS capped FROM r),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE
              ELSE weight * (SELECT arg_min(left_size, k) FROM c WHERE NOT capped)::DOUBLE
                   / (SELECT arg_min(left_weight, k) FROM c WHERE NOT capped)::DOUBLE END AS target
  FROM c),
p AS (
  SELECT d.*, source_size, target, floor(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, budget - whole * source_size - prefix)))::BIGINT AS taken
FROM e
"""
