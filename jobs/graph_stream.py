"""A knowledge graph that grows with its collection.

An incremental job for collections to which files are added: a file stream takes only files that no run has taken yet,
extracts relations by rules and writes, for each batch of the stream, the batch's edges in mergeable form; then the edges of
all batches are merged and calibrated.  Text is read once in the life of the collection; a run reads the new files and the batch
edges, which are far smaller.

    python -m jobs.graph_stream --documents D --output O --checkpoint C [--config jobs/graph_stream.json]

O/parts (partitions by batch): edges of each batch, with what merging needs.  A batch that is run again after a failure overwrites
its own partition.  O/edges (partitions by relation): all edges, overwritten by each run.  C belongs to O: the stream's checkpoint.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobs.common import Counter, log, main, settings
from tessera.operators import calibration, extraction
from tessera.storage import materialize, scratch
from tessera.streaming.extract import edge_parts, merged_parts, stream_rows

DEFAULTS = {"document_id": "doc_id", "document_text": "text", "chunk_size": 600, "overlap": 100, "max_files": 1000}


def watched(path: str) -> str:
    """``path`` as a pattern that only it matches: a stream then takes a single file as well as a folder."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return path if any(c in path for c in "{}[]*?") else f"{folder}/{{{name}}}"


def take_new(spark: SparkSession, documents: str, output: str, checkpoint: str, c: dict) -> dict:
    """Runs the stream over the files that are new, and waits for its end."""
    kinds = {f.name: f for f in spark.read.parquet(documents).schema}
    stream = spark.readStream.schema(StructType([kinds[c["document_id"]], kinds[c["document_text"]]])).option("maxFilesPerTrigger", c["max_files"]).parquet(watched(documents))
    docs = stream.select(F.col(c["document_id"]).alias("id"), F.col(c["document_text"]).alias("text"))
    done = {"batches": 0, "parts": 0}

    def write(rows: DataFrame, batch: int) -> None:
        count = Counter("parts")
        parts = count.of(edge_parts(rows)).withColumn("batch", F.lit(batch))
        parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/parts")
        done["batches"] += 1
        done["parts"] += count.rows
        log.info("batch %d: wrote %d edges", batch, count.rows)

    query = stream_rows(docs, c["chunk_size"], c["overlap"]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return done | {"documents": sum(p["numInputRows"] for p in query.recentProgress)}


def merge(spark: SparkSession, output: str) -> int:
    """Merges and calibrates the edges of all batches; gives their number."""
    try:
        parts = spark.read.parquet(f"{output}/parts")
    except AnalysisException as e:  # no batch has found an edge
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0
    count = Counter("edges")
    with scratch(spark):
        edges = materialize(extraction.with_combined_degree(materialize(merged_parts(parts.drop("batch")), "edges")), "edges")
        count.of(calibration.calibrate_edges(edges)).write.mode("overwrite").partitionBy("relation").parquet(f"{output}/edges")
    return count.rows


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: str | None = None) -> dict:
    """Takes what is new among the documents into the graph at ``output``; gives the numbers of rows read and written."""
    c = settings(spark, config, DEFAULTS)
    counts = take_new(spark, documents, output, checkpoint, c)
    counts["edges"] = merge(spark, output)
    log.info("read %(documents)d new documents in %(batches)d batches, wrote %(parts)d edges of batches and %(edges)d merged edges", counts)
    return counts


if __name__ == "__main__":
    main(run, {"documents": "folder of Parquet files to which files are added", "output": "folder for the tables parts and edges", "checkpoint": "folder for the stream's checkpoint"})
