"""Documents to overlapping text units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def chunk_documents(documents: DataFrame, size: int = 600, overlap: int = 100) -> DataFrame:
    """(id, document_id, text, position, token_count) of the units of (id, text), ``size`` words each, ``overlap`` shared.

    A document of no words has no unit.  Narrow: no shuffle.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap between 0 and size")
    stride = size - overlap
    split = documents.select(F.col("id").alias("document_id"), t.words(F.col("text")).alias("w"))
    last = F.greatest(F.ceil((F.size("w") - size) / stride), F.lit(0)).cast("int")
    places = F.when(F.size("w") > 0, F.sequence(F.lit(0), last))  # a filter on the words would find them twice
    units = split.select("document_id", "w", F.explode(places).alias("position")).select(
        "document_id", "position", F.array_join(F.slice("w", F.col("position") * stride + 1, F.lit(size)), " ").alias("text")
    )
    return units.select(
        t.stable_id("tu", F.col("document_id"), F.col("position"), F.col("text")).alias("id"),
        "document_id",
        "text",
        "position",
        t.estimate_tokens(F.col("text")).alias("token_count"),
    )
