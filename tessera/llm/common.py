"""Helpers shared by the training-data operators: words, shared storage, Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, scratch_path, shared_dir  # noqa: F401

#: A word is a maximal run of anything but ASCII white space (same set as ``bytes.split()``).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text column (null: 0), evaluated in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_text(doc_id: Column) -> Column:
    return doc_id.cast("string")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def any_order(df: DataFrame) -> list[Column]:
    """The columns of ``df`` that can be sorted by, for a choice among rows that must be the same in every run."""
    return [F.col(f"`{f.name}`") for f in df.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant", "interval"))]


def row_name(key: Column, text: Column, salt: str = "") -> Column:
    """A hash of a row's key and text as 32 hex digits: only rows that agree in both share it (nulls: "null" and empty)."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{salt}:"), F.md5(F.coalesce(text, F.lit("")))))


def rows(batch: pa.RecordBatch, *names: str):
    """The columns ``names`` of an Arrow batch as Python lists."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def arrow_schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


class Emitter:
    """Gathers output rows and hands them over as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = 4096):
        self.schema, self.limit = schema, limit
        self.columns: list[list] = [[] for _ in schema]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    def full(self) -> bool:
        return len(self.columns[0]) >= self.limit

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.columns = [[] for _ in self.schema]
        return batch

    def __len__(self) -> int:
        return len(self.columns[0])
