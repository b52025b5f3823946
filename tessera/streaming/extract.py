"""Continuous extraction: documents that arrive as a stream become relation rows, and edges are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..operators.chunking import chunk_documents
from ..operators.extraction import described_edges, relation_rows


def stream_rows(documents: DataFrame, chunk_size: int = 600, overlap: int = 100) -> DataFrame:
    """Relation rows of a stream of documents (id, text); stateless, so it scales with the source."""
    return relation_rows(chunk_documents(documents, chunk_size, overlap))


def append_rows(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows to Parquet files, exactly once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def edge_counts(rows: DataFrame) -> DataFrame:
    """Streaming aggregate: rows of each (source, target, relation), in update mode."""
    return rows.groupBy(t.casefold(F.col("source")).alias("source_key"), t.casefold(F.col("target")).alias("target_key"), "relation").agg(F.count("*").alias("weight"))


def edge_parts(rows: DataFrame) -> DataFrame:
    """Edges of some relation rows in a form that merges with those of others (see ``merged_parts``).

    (source_key, target_key, relation, first: the values of the first row, weight, units and docs: each with its first place).
    """
    first = F.min_by(F.struct("ord", "source", "target", "evidence", "evidence_type", "llm_conf", "ontology_ok"), "ord")
    placed = lambda c: F.collect_set(F.struct("ord", F.col(c).alias("value")))
    keys = {"source_key": t.casefold(F.col("source")), "target_key": t.casefold(F.col("target"))}
    return rows.withColumns(keys).groupBy(*keys, "relation").agg(first.alias("first"), F.count("*").cast("double").alias("weight"), placed("unit_id").alias("units"), placed("document_id").alias("docs"))


def merged_parts(parts: DataFrame) -> DataFrame:
    """The edges that ``merge_edges`` gives for the rows of all parts together, in whatever pieces they came."""
    listed = lambda c: F.array_distinct(F.transform(F.sort_array(F.flatten(F.collect_list(c))), lambda x: x["value"]))
    grouped = parts.groupBy("source_key", "target_key", "relation").agg(
        F.min_by("first", "first.ord").alias("f"), F.sum("weight").alias("weight"), listed("units").alias("text_unit_ids"), listed("docs").alias("source_docs")
    )
    return described_edges(grouped)


def windowed_events(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and mean values of events (ts, event_type, value) per window, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
