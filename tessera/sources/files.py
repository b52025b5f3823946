"""Files to documents.  All reading goes through Spark's readers, so any file system that Spark knows will do."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as t

ROW = "path string, row int, text string, metadata map<string,string>, relationships array<struct<source:string,target:string,relation:string,description:string>>"
TEXT, HTML, TABLE, JSON, PDF = (".txt", ".md"), (".html", ".htm"), (".csv",), (".json",), (".pdf",)
WHOLE, LINES = (*TEXT, *HTML, *TABLE, *JSON, *PDF), ".jsonl"


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        if data := data.strip():
            self.found.append(data)


def html_text(source: str | None) -> str:
    """The text nodes of a page (those of scripts and styles too), stripped, joined by spaces."""
    parser = _Text()
    parser.feed(source or "")
    return " ".join(parser.found)


#: Pages of an Arrow batch that are Python strings at a time.
PAGES = 64


@F.arrow_udf(StringType())
def html_to_text(source: pa.Array) -> pa.Array:
    some = [pa.array([html_text(x) for x in source.slice(at, PAGES).to_pylist()], pa.string()) for at in range(0, len(source), PAGES)]
    return pa.concat_arrays(some) if some else pa.array([], pa.string())


def _plain(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _relations(value: object) -> list[tuple]:
    rows = value if isinstance(value, list) else []
    return [tuple(None if x.get(k) is None else str(x[k]) for k in ("source", "target", "relation", "description")) for x in rows if isinstance(x, dict)]


def csv_rows(content: bytes) -> Iterator[tuple[str, dict, list]]:
    """The rows of a CSV file, decoded and parsed as they are taken."""
    csv.field_size_limit(1 << 31)  # texts may be long
    lines = io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", "replace", newline="")
    for row in csv.DictReader(lines):
        yield " ".join(map(str, row.values())), {str(k): _plain(v) for k, v in row.items() if v is not None}, []


def parse_file(suffix: str, content: bytes) -> Iterable[tuple[str, dict, list]]:
    """(text, metadata, supplied relationships) of each row of a file; files of another kind have none."""
    if suffix in PDF:
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF needs the optional package pypdf") from e
        return [("\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages), {}, [])]
    if suffix in TABLE:
        return csv_rows(content)
    body = content.decode("utf-8", "replace")
    if suffix in TEXT:
        return [(body, {}, [])]
    if suffix in HTML:
        return [(html_text(body), {}, [])]
    if suffix in JSON:
        found = json.loads(body)
        return [row for v in (found if isinstance(found, list) else [found]) for row in json_row(v)]
    return []


def json_row(v: object) -> list[tuple[str, dict, list]]:
    """The row of a JSON value: a text, or an object with one; other values have none."""
    if isinstance(v, str):
        return [(v, {}, [])]
    if not isinstance(v, dict):
        return []
    text = next((str(v[k]) for k in ("text", "content", "body") if v.get(k)), "")
    return [(text, {str(k): _plain(x) for k, x in v.items() if x is not None and k not in ("text", "content", "body", "relationships")}, _relations(v.get("relationships")))]


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(path, row, value) of the lines that are not blank, of text that Spark reads in splits, with their number in the file.

    Lines are numbered inside their split; what comes before a split in its file is a running sum over the counts of splits.
    """
    own = lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value").where(t.strip(F.col("value")) != "")
    counts = own.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = own.withColumn("_k", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at"))).join(before, ["_file", "_block"])
    # the path as the reader of whole files gives it
    path = F.regexp_replace(F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")
    return placed.select(path.alias("path"), (F.col("_before") + F.col("_k") - 1).cast("int").alias("row"), "value")


def named(*suffixes: str) -> str:
    """A pattern of file names with one of the suffixes, in any case."""
    return "*{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in suffixes) + "}"


#: Rows, and characters of texts, that a task passes on together.
PIECE_ROWS, PIECE_CHARS = 1000, 1 << 22


def pieces(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """``rows`` (path, row, text, ..) in lists of bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if len(held) >= PIECE_ROWS or size >= PIECE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """ROW for each row of every readable file under ``path`` (a file or a folder, read recursively).

    Files of JSON lines are read in splits, so that several tasks share a large one; all others are values that a task holds.  The
    rows of a CSV file are parsed and passed on piece by piece, beside its bytes a task holds one piece.
    """
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    files = spark.read.option("recursiveFileLookup", "true").format("binaryFile").option("pathGlobFilter", named(*WHOLE)).load(path).select("path", "content", suffix.alias("suffix"))
    lines = numbered_lines(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", named(LINES)).text(path))

    def parse_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, *r) for p, i, x in zip(pdf["path"], pdf["row"], pdf["value"], strict=True) for r in json_row(json.loads(x))]
            yield pd.DataFrame(rows, columns=["path", "row", "text", "metadata", "relationships"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = ((p, i, *r) for p, s, c in zip(pdf.path, pdf.suffix, pdf.content, strict=True) for i, r in enumerate(parse_file(s, bytes(c))))
            for some in pieces(rows):
                yield pd.DataFrame(some, columns=["path", "row", "text", "metadata", "relationships"])

    return files.mapInPandas(parse, ROW).unionByName(lines.mapInPandas(parse_lines, ROW))


def nested(key: str) -> Column:
    """A metadata value, or that of the nested metadata."""
    own = F.try_element_at("metadata", F.lit(key))
    return F.coalesce(F.nullif(own, F.lit("")), F.get_json_object(F.try_element_at("metadata", F.lit("metadata")), f"$.{key}"), F.lit(""))


def documents(rows: DataFrame) -> DataFrame:
    """Documents (id, title, text, source_path, source, category, published_at, author, url, relationships) of file rows.

    White space is collapsed; blank rows are dropped; the id is made of path, row number and the first 256 characters.
    """
    clean = rows.withColumn("text", t.strip(F.regexp_replace("text", r"(?U)\s+", " "))).where("text <> ''")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", "")
    url = F.coalesce(F.nullif(F.get_json_object(F.try_element_at("metadata", F.lit("metadata")), "$.url"), F.lit("")), F.try_element_at("metadata", F.lit("id")), F.lit(""))
    return clean.select(
        t.stable_id("doc", F.col("path"), F.col("row"), F.substring("text", 1, 256)).alias("id"),
        F.coalesce(F.nullif(F.try_element_at("metadata", F.lit("title")), F.lit("")), stem).alias("title"), "text", F.col("path").alias("source_path"),
        *[nested(k).alias(k) for k in ("source", "category", "published_at", "author")], url.alias("url"), "relationships",
    )


def ingest(spark: SparkSession, path: str) -> DataFrame:
    return documents(read_files(spark, path))
