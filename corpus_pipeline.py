"""The corpus pipeline: toxicity filter, SimHash near-dedup, substring dedup, mixing to target weights, packing.

Every stage takes and returns whole rows; columns of any other name, also one that a stage uses for itself,
pass through.  Null and empty texts are documents like any other until the mixing, which takes words; an
empty table stays empty.  Equal inputs give equal outputs, whatever the order or partitions of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import any_order, fresh, table
from tessera.storage import remove, scratch, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model, trained on the labels of these documents, predicts toxic.

    Null and empty texts stay; copies of a text share its fate; null ids are scored, but carry no label.
    """
    from tessera.llm.toxicity import VERDICT, classify

    names = fresh(docs, *VERDICT)
    kept = classify(docs, table(spark, sf_dir, "labels"), names).where(F.col(names[VERDICT.index("predicted")]) == 0)
    return kept.select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the smallest doc_id (null last), ties by the text's MD5.

    Null and empty texts are copies of each other.  Of rows equal in doc_id and text the one whose other
    columns come first stays.  A text of any length is compared whole.
    """
    from tessera.llm.simhash import near_duplicates

    own, name, turn = fresh(docs, "name", "other_name", "turn")
    named = lambda digest: F.concat(digest, F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    kept = near_duplicates(docs).where("kept").select(named(F.col("digest")).alias(name))
    marked = docs.withColumn(own, named(F.md5(F.coalesce("text", F.lit("")))))
    left = marked.join(kept, F.col(own) == F.col(name), "left_semi")
    first = left.withColumn(turn, F.row_number().over(Window.partitionBy(own).orderBy(*any_order(docs)))).where(F.col(turn) == 1)
    return first.select(*[f"`{c}`" for c in docs.columns])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages of 13 words or more that a document with a smaller doc_id has; drops what is left empty.

    Null texts and texts without words stay; see ``without_repeats`` for ties, repeated rows and null ids.
    """
    from tessera.llm.fmindex import without_repeats

    return without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out whole documents so that the sources (null is one) reach their target weights.

    Texts without words are never taken; repeated rows share what the mix takes of them evenly.
    """
    from tessera.llm.mixing import mixed

    return mixed(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of the mixed corpus: one row for each document and copy of it.

    Null texts have no tokens and are packed too; a text above the budget is a batch of its own.
    """
    from tessera.llm.packing import pack

    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing to target weights", mix_sources),
    ("packing", pack_batches),
]

#: The classifier and the fingerprints are no SQL; tests/llm/test_pipeline.py follows all stages by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again.

    A stage's own tables go when it ends, and so does the result before it: two results are there at most.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{k}")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
