"""The index: all tables that retrieval reads, as lazy plans or as files."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.errors import AnalysisException

from ..functions import text as t
from ..operators import chunking, communities, enrichment, extraction, graph
from ..operators.calibration import calibrate_edges
from ..storage import materialize

DOCUMENT_FIELDS = ("id", "title", "text", "source", "category", "published_at", "author", "url")


@dataclass(frozen=True)
class Index:
    """documents (DOCUMENT_FIELDS), units, entities, edges (calibrated), communities and reports."""

    documents: DataFrame
    units: DataFrame
    entities: DataFrame
    edges: DataFrame
    communities: DataFrame | None = None
    reports: DataFrame | None = None

    def save(self, path: str) -> None:
        for f in fields(self):
            if (table := getattr(self, f.name)) is not None:
                table.write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """Reads an index; communities and reports may be missing, the other tables must be there."""
        found = {}
        for f in fields(cls):
            try:
                found[f.name] = spark.read.parquet(f"{path}/{f.name}")
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                if f.name not in ("communities", "reports"):
                    raise FileNotFoundError(f"index {path} has no table {f.name}") from e
        return cls(**found)

    def visible(self, calibrated: bool = True, inferred: bool = True) -> Index:
        """The index as a retrieval variant sees it: without calibration every edge is reliable; inferred edges may be hidden."""
        edges = self.edges if inferred else self.edges.where("evidence_type <> 'inferred'")
        if not calibrated:
            edges = edges.withColumn("reliability", F.lit(1.0))
        return Index(self.documents, self.units, self.entities, edges, self.communities, self.reports)


def with_document_fields(documents: DataFrame) -> DataFrame:
    """``documents`` (id, text, ...) with all DOCUMENT_FIELDS; missing ones are empty."""
    return documents.select(*[F.col(c) if c in documents.columns else F.lit("").alias(c) for c in DOCUMENT_FIELDS])


@dataclass
class Extraction:
    """How to extract: by rules, or by a client whose answers are kept under ``path``, as they come, and used again (``resume``).

    ``max_units``: only so many units, by document and position.  ``stats`` says how the client's units went.
    """

    client: enrichment.Client | None = None
    path: str | None = None
    resume: bool = True
    max_units: int | None = None
    continue_on_error: bool = True
    stats: dict[str, int] | None = None

    def rows(self, units: DataFrame, documents: DataFrame, supplied: DataFrame | None) -> DataFrame:
        if self.client is None:
            return extraction.relation_rows(units, supplied)
        answers = enrichment.Answers(units.sparkSession, f"{self.path}/llm_answers" if self.path else None, self.resume)
        payloads, errors = enrichment.extract_with_client(units, documents, self.client, None, self.max_units, answers)
        failed = errors.count()
        if self.path:
            log = read_table(units.sparkSession, f"{self.path}/llm_errors")
            told = errors if log is None else materialize(enrichment.upsert_errors(log, errors, payloads), "errors")
            told.write.mode("overwrite").parquet(f"{self.path}/llm_errors")
        if failed and not self.continue_on_error:
            raise RuntimeError(f"{failed} units failed: {errors.first()['error']}")
        good = payloads.count()
        asked = enrichment.valid_answers(answers.told("extract").where("error is null").select("digest", "answer")).count()
        self.stats = {"successful_units": good, "cached_units": good - asked, "failed_units": failed}
        return enrichment.payload_rows(payloads, units)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, written anew so that the path can be overwritten; None if there is none."""
    try:
        return materialize(spark.read.parquet(path), "table")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def build_index(documents: DataFrame, chunk_size: int = 600, overlap: int = 100, with_communities: bool = True, cut: bool = True, how: Extraction | None = None, keep_units: bool = True, keep_graph: bool = True) -> Index:
    """Indexes documents (id, text, optional DOCUMENT_FIELDS and ``relationships``) by the rule extractor, or as ``how`` says.

    Units, rows and edges are each written once and read many times (``cut``); else the plan stays lazy throughout.  Without
    ``keep_units`` the units stay a plan, for those who read entities and edges alone; without ``keep_graph`` entities and edges do, for
    those who read documents and units alone.  How many tokens a unit has is counted by those who ask.
    """
    plan = lambda df, name: df
    docs = with_document_fields(documents)
    units = chunking.chunk_documents(docs, chunk_size, overlap)
    if cut and keep_units:
        units = materialize(units.drop("token_count"), "units").withColumn("token_count", t.estimate_tokens(F.col("text")))
    keep = materialize if cut and keep_graph else plan
    supplied = documents.select("id", "relationships") if "relationships" in documents.columns else None
    rows = keep((how or Extraction()).rows(units, docs, supplied), "rows")
    edges = keep(calibrate_edges(extraction.with_combined_degree(extraction.merge_edges(rows))), "edges")
    entities = keep(extraction.merge_entities(rows, edges), "entities")
    if not with_communities:
        return Index(docs, units, entities, edges)
    members = keep(communities.community_labels(entities, edges), "members")
    return Index(docs, units, entities, edges, communities.communities(members, edges), communities.reports(members, edges))


def finalize_enriched(index: Index, entities: DataFrame, edges: DataFrame) -> Index:
    """The index with enriched entities and edges: aliases resolved, degrees counted, edges calibrated and communities found anew."""
    entities, edges = graph.resolve_aliases(entities, edges)
    edges = materialize(calibrate_edges(extraction.with_combined_degree(edges)), "edges")
    degree = extraction.degrees(edges)
    entities = entities.drop("degree").join(degree, "title", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    entities = materialize(entities, "entities")
    members = materialize(communities.community_labels(entities, edges), "members")
    return Index(index.documents, index.units, entities, edges, communities.communities(members, edges), communities.reports(members, edges))


def enrich_index(index: Index, client: enrichment.Client, steps: list[str] | None = None, answers: enrichment.Answers | None = None) -> Index:
    """The index after the named enrichment steps (none named: all); ``answers``: where what the client says is kept and used again."""
    entities, edges = enrichment.enrich_graph(index.entities, index.edges, client, steps, answers)
    return finalize_enriched(index, materialize(entities, "entities"), materialize(edges, "edges"))


def test_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents`` in the form that the index takes.

    The table has no titles; a text's first 12 words are one, as a headline would be.  The language is the category.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = F.regexp_extract(t.nvl("text"), r"(?U)^\s*\S+(?:\s+\S+){0,11}", 0)  # the rest of the text is not looked at
    title = F.array_join(t.words(head), " ")
    return docs.select(F.col("doc_id").alias("id"), title.alias("title"), "text", "source", F.col("lang").alias("category"))
