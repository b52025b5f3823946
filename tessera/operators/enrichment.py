"""Enrichment of the graph by a text-generation client, and extraction by such a client.

A client is any object with ``chat_json(system, user, schema_hint) -> dict`` that can be pickled.  Prompts are
a table; ``ask`` sends them from the executors, a few at a time per task, and writes answers or errors before anything
reads them, so a prompt is paid for once and a failed one leaves its row as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as r
from ..functions import text as t
from ..storage import materialize, scratch_path
from . import graph

STEPS = ("questions", "summaries", "importance", "contradictions", "entities", "infer")


class Client(Protocol):
    def chat_json(self, system: str, user: str, schema_hint: str | None = None) -> dict: ...


INSTRUCTIONS = {
    "questions": ("Write three to five questions that this fact alone answers, with the names as given.", '{"questions": ["string"]}'),
    "summaries": ("Put the triple and its evidence into one sentence; keep both names, add nothing.", '{"summary": "string"}'),
    "importance": ("Rate from 0 to 1 how central this fact is.", '{"importance": 0.0, "reasoning": "string"}'),
    "contradictions": ("Say whether facts about this pair contradict each other, and which.", '{"has_contradiction": false, "explanation": "string", "conflicting_ids": []}'),
    "entities": ("Describe the entity from its facts alone; give aliases and a category.", '{"description": "string", "aliases": ["string"], "category": "string"}'),
    "infer": ("Infer a direct relation between the ends only if it follows from both facts, else null.", '{"inferred": {"source": "string", "target": "string", "relation": "string", "description": "string", "confidence": 0.0}}'),
    "extract": ("List the entities and relationships of the text.", '{"entities": [], "relationships": []}'),
}


class RuleClient:
    """A client that answers by rules, without a model: for tests and offline runs."""

    def chat_json(self, system: str, user: str, schema_hint: str | None = None) -> dict:
        lines = [x.split(": ", 1)[-1] for x in user.split("\n")]
        if '"questions"' in schema_hint:
            return {"questions": [f"What is known of {lines[0].rstrip('.')}?"]}
        if '"summary"' in schema_hint:
            return {"summary": f"In short: {lines[0]}"}
        if '"importance"' in schema_hint:
            return {"importance": (len(lines[0]) % 10) / 10, "reasoning": "length"}
        if '"has_contradiction"' in schema_hint:
            ids = [x.split("]")[0][3:] for x in user.split("\n") if x.startswith("- [")]
            return {"has_contradiction": len(ids) > 2, "explanation": "many relations", "conflicting_ids": ids[:2]}
        if '"category"' in schema_hint:
            return {"description": f"About {lines[0]}", "aliases": [lines[0].upper()], "category": "Thing"}
        if '"inferred"' in schema_hint:
            return {"inferred": {"relation": "associated_with", "description": "follows from a chain", "confidence": 0.6}}
        return {"entities": [], "relationships": []}


#: Prompts whose answers are committed together, and prompts of a task.
PER_COMMIT, PER_TASK = 20_000, 200


class Answers:
    """What a client said, a row a prompt: a Parquet table at ``path`` to which each commit of about ``per_commit`` prompts is appended.

    Nothing that was answered is asked again: a run that is killed leaves all commits but the one at work, and the next one asks for the rest.
    Failed prompts are rows too, with the error and what became of each attempt; they are asked again by the next run.  Without
    ``resume`` a run uses only its own answers.  Without ``path`` the table is scratch data.
    """

    FIELDS = "digest string, step string, run string, answer string, error string, attempts string"

    def __init__(self, spark: SparkSession, path: str | None = None, resume: bool = True, per_commit: int = PER_COMMIT):
        self.spark, self.path, self.resume, self.per_commit = spark, path or scratch_path(spark, "answers"), resume, per_commit
        self.run = uuid.uuid4().hex

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.FIELDS).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.FIELDS)

    def known(self, step: str, usable: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(digest, answer) of what was answered, once for each prompt; only ``usable`` ones, if it is given."""
        good = self.rows().where((F.col("step") == step) & F.col("error").isNull())
        good = (good if self.resume else good.where(F.col("run") == self.run)).select("digest", "answer")
        return (usable(good) if usable else good).groupBy("digest").agg(F.min("answer").alias("answer"))

    def told(self, step: str) -> DataFrame:
        """(digest, answer, error) of the prompts of a step that were asked in this run."""
        return self.rows().where((F.col("step") == step) & (F.col("run") == self.run)).select("digest", "answer", "error").dropDuplicates(["digest"])

    def attempts(self) -> DataFrame:
        """(step, run, digest, attempt, model, status, error, finish_reason, usage, content): the log of a client that tells of its attempts."""
        told = F.from_json("attempts", "array<struct<attempt:int,model:string,status:string,error:string,finish_reason:string,usage:string,content:string>>")
        return self.rows().select("step", "run", "digest", F.explode(told).alias("a")).select("step", "run", "digest", "a.*")


def asking(client: Client, step: str, workers: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sends prompts (digest, prompt), ``workers`` at a time, and gives (digest, answer, error, attempts)."""
    system, hint = INSTRUCTIONS[step]

    def one(prompt: str) -> tuple[str | None, str | None, str | None]:
        tried: list[dict] = []
        own = client.recording(tried.append) if hasattr(client, "recording") else client
        told = lambda: json.dumps(tried, ensure_ascii=False, default=str) if tried else None
        try:
            return json.dumps(own.chat_json(system, prompt, hint), ensure_ascii=False), None, told()
        except Exception as e:  # noqa: BLE001 - any failure of a client is a failed prompt
            return None, f"{type(e).__name__}: {e}", told()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                told = list(pool.map(one, pdf["prompt"]))
                yield pdf[["digest"]].assign(**{c: [x[i] for x in told] for i, c in enumerate(("answer", "error", "attempts"))})

    return run


def ask(prompts: DataFrame, client: Client, step: str, key: list[str], answers: Answers | None = None, usable: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(*key, answer, error) for prompts (*key, prompt): the JSON of the answer, or what went wrong.

    Every distinct prompt is asked at most once: what has no usable answer yet is asked and written here, when ``ask`` is called, and the result
    only reads the table.  ``usable``: keeps those of (digest, answer) that need not be asked for again.
    """
    system, hint = INSTRUCTIONS[step]
    answers = answers or Answers(prompts.sparkSession)
    name = F.sha2(F.concat_ws("\x1f", F.lit(step), F.lit(system), F.lit(hint), F.col("prompt")), 256)
    told = materialize(prompts.select(*key, t.nvl("prompt").alias("prompt")).withColumn("digest", name), "prompts")
    known = answers.known(step, usable)
    pending = materialize(told.select("digest", "prompt").dropDuplicates(["digest"]).join(known.select("digest"), "digest", "left_anti"), "pending")
    n = pending.count()
    commits = -(-n // answers.per_commit)
    workers = getattr(getattr(client, "settings", None), "workers", 12)
    tasks = max(1, min(prompts.sparkSession.sparkContext.defaultParallelism, -(-n // max(1, commits) // PER_TASK)))
    for c in range(commits):
        part = pending.where(F.pmod(F.xxhash64("digest"), F.lit(commits)) == c).repartition(tasks, "digest")
        said = part.mapInPandas(asking(client, step, workers), "digest string, answer string, error string, attempts string")
        said.withColumns({"step": F.lit(step), "run": F.lit(answers.run)}).write.mode("append").parquet(answers.path)
    good = answers.known(step, usable).withColumn("error", F.lit(None).cast("string"))
    rest = answers.told(step).join(good.select("digest"), "digest", "left_anti")
    return told.join(good.unionByName(rest), "digest").select(*key, "answer", "error")


def lines(*parts: tuple[str, Column | str]) -> Column:
    """``label: value`` lines."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), t.nvl(F.col(v) if isinstance(v, str) else v)) for label, v in parts])


def spaced(relation: str = "relation") -> Column:
    return F.replace(F.col(relation), F.lit("_"), F.lit(" "))


def _edge_step(edges: DataFrame, client: Client, answers: Answers | None, step: str, prompt: Column, schema: str, values: dict[str, Column]) -> DataFrame:
    told = ask(edges.select("id", prompt.alias("prompt")), client, step, ["id"], answers)
    parsed = told.select("id", F.from_json("answer", schema).alias("a"))
    return edges.join(parsed, "id", "left").withColumns(values).select(*edges.columns)


def enrich_questions(edges: DataFrame, client: Client, answers: Answers | None = None) -> DataFrame:
    prompt = lines(("Fact", F.concat("source", F.lit(" "), spaced(), F.lit(" "), "target", F.lit("."))), ("Description", "description"), ("Evidence", "evidence_text"))
    good = F.filter(F.col("a.questions"), lambda q: q.isNotNull() & (q != ""))
    return _edge_step(edges, client, answers, "questions", prompt, "questions array<string>", {"generated_questions": F.coalesce(good, "generated_questions")})


def enrich_summaries(edges: DataFrame, client: Client, answers: Answers | None = None) -> DataFrame:
    triple = F.concat(F.lit("("), "source", F.lit(", "), "relation", F.lit(", "), "target", F.lit(")"))
    prompt = lines(("Triple", triple), ("Evidence", "evidence_text"), ("Description", "description"))
    return _edge_step(edges, client, answers, "summaries", prompt, "summary string", {"semantic_summary": F.coalesce(F.nullif("a.summary", F.lit("")), "semantic_summary")})


def enrich_importance(edges: DataFrame, client: Client, answers: Answers | None = None) -> DataFrame:
    prompt = lines(("Fact", F.concat("source", F.lit(" "), spaced(), F.lit(" "), "target")), ("Evidence", "evidence_text"))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("a.importance", F.lit(0.5))))
    return _edge_step(edges, client, answers, "importance", prompt, "importance double", {"importance": F.when(F.col("a").isNotNull(), clipped).otherwise(F.col("importance"))})


def enrich_contradictions(edges: DataFrame, client: Client, answers: Answers | None = None) -> DataFrame:
    """Marks the edges that the client names, in pairs of entities with two edges or more."""
    keyed = edges.withColumns({"_s": t.casefold(F.col("source")), "_t": t.casefold(F.col("target"))})
    fact = F.concat(F.lit("- ["), "id", F.lit("] "), "source", F.lit(" "), "relation", F.lit(" "), "target", F.lit(": "), "description")
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id", fact.alias("f")))), lambda x: x["f"]), "\n")
    groups = keyed.groupBy("_s", "_t").agg(told.alias("facts"), F.min_by(F.struct("source", "target"), "ord").alias("p"), F.count("*").alias("n")).where("n >= 2")
    prompt = F.concat(F.lit("Entity pair: ("), "p.source", F.lit(", "), "p.target", F.lit(")\nEdges:\n"), "facts")
    said = ask(groups.select("_s", "_t", prompt.alias("prompt")), client, "contradictions", ["_s", "_t"], answers)
    parsed = said.select("_s", "_t", F.from_json("answer", "has_contradiction boolean, explanation string, conflicting_ids array<string>").alias("a")).where("a.has_contradiction")
    bad = parsed.select("_s", "_t", F.explode("a.conflicting_ids").alias("id"), t.nvl("a.explanation").alias("_x")).dropDuplicates(["_s", "_t", "id"])
    marked = keyed.join(bad, ["_s", "_t", "id"], "left")
    return marked.withColumns(
        {"contradiction_info": F.coalesce("_x", "contradiction_info"), "conflict_status": F.when(F.col("_x").isNotNull(), "contradiction").otherwise(F.col("conflict_status"))}
    ).select(*edges.columns)


def enrich_entities(entities: DataFrame, edges: DataFrame, client: Client, context: int = 10, answers: Answers | None = None) -> DataFrame:
    """Descriptions, aliases and categories of the entities that have edges; at most ``context`` facts go into a prompt."""
    fact = F.concat("source", F.lit(" "), "relation", F.lit(" "), "target", F.lit(": "), "description")
    ends = edges.select("ord", "id", fact.alias("f"), F.posexplode(F.array("source", "target")).alias("end", "e")).withColumn("_k", t.casefold(F.col("e")))
    facts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id", "end", "f"))), lambda x: x["f"]), "\n")
    first = Window.partitionBy("_k").orderBy("ord", "id", "end")  # the first are picked out before a hub's facts meet
    ends = ends.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= context)
    known = ends.groupBy("_k").agg(facts.alias("facts"))
    keyed = entities.withColumn("_k", t.casefold(F.col("title"))).join(known, "_k")
    prompt = lines(("Entity", "title"), ("Type", "type"), ("Current description", "description"), ("Graph context", "facts"))
    told = ask(keyed.select("id", prompt.alias("prompt")), client, "entities", ["id"], answers)
    parsed = told.select("id", F.from_json("answer", "description string, aliases array<string>, category string").alias("a"))
    return entities.join(parsed, "id", "left").withColumns(
        {
            "enriched_description": F.coalesce(F.nullif("a.description", F.lit("")), "enriched_description"),
            "aliases": F.coalesce(F.filter(F.col("a.aliases"), lambda x: x.isNotNull() & (x != "")), "aliases"),
            "category": F.coalesce(F.nullif("a.category", F.lit("")), "category"),
        }
    ).select(*entities.columns)


def enrich_inference(edges: DataFrame, client: Client, max_paths: int = 200, answers: Answers | None = None) -> DataFrame:
    """``edges`` and the edges that the client infers from chains of two."""
    pairs = graph.inference_pairs(edges, limit=max_paths)
    fact = F.concat("source", F.lit(" "), "relation", F.lit(" "), "target", F.lit(": "), "description")
    a = edges.select(F.col("id").alias("seed_id"), fact.alias("_f1"), F.col("source").alias("_from"))
    b = edges.select(F.col("id").alias("next_id"), fact.alias("_f2"), F.col("target").alias("_to"))
    prompt = F.concat(F.lit("Path:\n1. "), "_f1", F.lit("\n2. "), "_f2", F.lit("\n\nEnds: "), "_from", F.lit(" and "), "_to")
    asked = pairs.join(a, "seed_id").join(b, "next_id").select("seed_id", "next_id", "k", prompt.alias("prompt"))
    told = ask(asked, client, "infer", ["seed_id", "next_id", "k"], answers)
    parsed = told.select("seed_id", "next_id", "k", F.from_json("answer", "inferred struct<relation:string,description:string,confidence:double>").alias("a"))
    inferred = parsed.where("a.inferred is not null").select("seed_id", "next_id", "k", "a.inferred.relation", "a.inferred.description", "a.inferred.confidence")
    last = edges.agg(F.max("ord").alias("_last"))  # one row; what is inferred comes after all that is told
    new = graph.infer_edges(edges, inferred).crossJoin(F.broadcast(last))
    ordinal = F.col("_last").withField("group", F.lit(9)).withField("k", F.row_number().over(Window.orderBy("id")))  # at most ``max_paths`` rows
    new = new.withColumn("ord", ordinal.cast(edges.schema["ord"].dataType)).drop("_last")
    return edges.unionByName(new, allowMissingColumns=True).withColumns({"generated_questions": F.coalesce("generated_questions", F.array().cast("array<string>")), "semantic_summary": t.nvl("semantic_summary")})


def enrich_graph(entities: DataFrame, edges: DataFrame, client: Client, steps: list[str] | None = None, answers: Answers | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs the named steps (none named: all; unknown names are ignored) in the order of STEPS; the edges are written after each."""
    active = set(steps) & set(STEPS) if steps else set(STEPS)
    answers = answers or Answers(edges.sparkSession)
    for step, run in (("questions", enrich_questions), ("summaries", enrich_summaries), ("importance", enrich_importance), ("contradictions", enrich_contradictions)):
        if step in active:
            edges = materialize(run(edges, client, answers), "edges")
    if "entities" in active:
        entities = enrich_entities(entities, edges, client, answers=answers)
    if "infer" in active:
        edges = enrich_inference(edges, client, answers=answers)
    return entities, edges


# --- extraction by a client ---------------------------------------------------------------------------

PAYLOAD = (
    "struct<entities:array<struct<name:string,title:string,type:string,description:string>>,"
    "relationships:array<struct<source:string,target:string,relation:string,description:string,evidence_text:string,evidence_type:string,"
    "source_type:string,target_type:string,llm_conf:string,confidence:string,useful_for:array<string>>>>"
)


def validate_payload(answers: DataFrame) -> DataFrame:
    """(.., payload, error) of answers (.., answer, error): rows without names or ends are dropped; an answer without any good row is an error."""
    p = F.from_json("answer", PAYLOAD)
    named = lambda e: t.strip(t.nvl(F.coalesce(F.nullif(e["name"], F.lit("")), e["title"]))) != ""
    ends = lambda x: (t.strip(t.nvl(x["source"])) != "") & (t.strip(t.nvl(x["target"])) != "")
    kept = answers.withColumn("p", p).withColumns({"_e": F.filter(F.col("p.entities"), named), "_r": F.filter(F.col("p.relationships"), ends)})
    bad = F.col("_e").isNull() | F.col("_r").isNull()
    none = (F.size("_e") == 0) & (F.size("_r") == 0)
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(bad, "no arrays of entities and relationships").when(none, "no valid entities or relationships")
    payload = F.when(error.isNull(), F.struct(F.col("_e").alias("entities"), F.col("_r").alias("relationships")))
    return kept.withColumn("payload", payload).withColumn("error", error).drop("p", "_e", "_r", "answer")


def valid_answers(answers: DataFrame) -> DataFrame:
    """Those of (digest, answer) that are valid payloads."""
    kept = answers.withColumn("_kept", F.col("answer")).withColumn("error", F.lit(None).cast("string"))
    return validate_payload(kept).where("error is null").select("digest", F.col("_kept").alias("answer"))


def payload_rows(payloads: DataFrame, units: DataFrame) -> DataFrame:
    """Relation rows (as of ``extraction.relation_rows``) from payloads (unit_id, payload); names take the first spelling of their key."""
    base = payloads.select("unit_id", "payload").join(units.select(F.col("id").alias("unit_id"), "document_id", "position", F.col("text").alias("_unit")), "unit_id")
    raw = base.select("unit_id", "document_id", "position", "_unit", F.posexplode("payload.relationships").alias("k", "x"))
    ents = base.select("document_id", "position", F.posexplode("payload.entities").alias("k", "x")).select(
        F.struct("document_id", "position", F.lit(0).alias("group"), "k", F.lit(0).alias("end")).alias("at"), t.strip(t.nvl(F.coalesce(F.nullif("x.name", F.lit("")), "x.title"))).alias("name")
    )
    ends = raw.select("document_id", "position", "k", F.posexplode(F.array("x.source", "x.target")).alias("end", "name")).select(
        F.struct("document_id", "position", F.lit(1).alias("group"), "k", "end").alias("at"), t.strip(t.nvl("name")).alias("name")
    )
    canon = ents.unionByName(ends).withColumn("key", t.entity_key(F.col("name"))).where("key <> ''").groupBy("key").agg(F.min_by("name", "at").alias("canon"))
    for end in ("source", "target"):
        raw = raw.withColumn("key", t.entity_key(t.strip(F.col(f"x.{end}")))).join(canon.withColumnRenamed("canon", end), "key").drop("key")
    norm = r.normalize_relation(t.strip(F.coalesce(F.nullif("x.relation", F.lit("")), F.lit("associated_with"))))
    told = raw.withColumn("norm", norm)
    plain = F.concat("source", F.lit(" "), F.replace("norm.relation", F.lit("_"), F.lit(" ")), F.lit(" "), "target")
    told = told.withColumn("description", t.strip(F.coalesce(F.nullif("x.description", F.lit("")), plain)))
    claim = t.strip(F.coalesce(F.nullif("x.evidence_text", F.lit("")), "description"))
    inside = lambda c: t.casefold(F.col("_unit")).contains(t.casefold(c))
    number = lambda c: F.nullif(F.col(c).try_cast("double"), F.lit(0.0))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number("x.llm_conf"), number("x.confidence"), F.lit(0.75))))
    return told.where("source <> target").select(
        F.struct("document_id", "position", F.lit(1).alias("group"), "k").alias("ord"), "unit_id", "document_id", "source", "target",
        F.col("norm.relation").alias("relation"), F.col("norm.ontology_ok").alias("ontology_ok"),
        F.when(inside(claim), claim).when(inside(F.col("description")), F.col("description")).otherwise(F.col("_unit")).alias("evidence"),
        t.nvl(F.nullif("x.evidence_type", F.lit("")), "explicit").alias("evidence_type"), sure.alias("llm_conf"),
    )


def extract_with_client(
    units: DataFrame, documents: DataFrame, client: Client, cache: DataFrame | None = None, max_units: int | None = None, answers: Answers | None = None
) -> tuple[DataFrame, DataFrame]:
    """(payloads (unit_id, document_id, payload), errors (unit_id, document_id, error)); every unit is in one of them.

    ``cache`` (unit_id, answer): answers given by unit, which are used again if they are valid.  ``answers``: the table of what was answered
    before and is now; what is valid there is not asked for again either.  ``max_units``: so many units by document and position.
    """
    if max_units:
        units = units.orderBy("document_id", "position").limit(max_units)
    titles = documents.select(F.col("id").alias("document_id"), F.col("title").alias("_title"))
    prompt = F.concat(F.lit("Document title: "), t.nvl("_title"), F.lit("\nChunk id: "), "id", F.lit("\nText:\n"), "text")
    prompts = units.join(titles, "document_id").select(F.col("id").alias("unit_id"), "document_id", prompt.alias("prompt"))
    known = None
    if cache is not None:
        kept = units.select(F.col("id").alias("unit_id"), "document_id").join(cache, "unit_id").withColumn("error", F.lit(None).cast("string"))
        known = materialize(validate_payload(kept.select("unit_id", "document_id", "answer", "error")).where("error is null"), "known")
        prompts = prompts.join(known.select("unit_id"), "unit_id", "left_anti")
    told = validate_payload(ask(prompts, client, "extract", ["unit_id", "document_id"], answers, valid_answers))
    every = materialize(told if known is None else told.unionByName(known), "payloads")  # payloads and errors are parts of one table
    return every.where("error is null").select("unit_id", "document_id", "payload"), every.where("error is not null").select("unit_id", "document_id", "error")


def upsert_errors(log: DataFrame, errors: DataFrame, resolved: DataFrame) -> DataFrame:
    """The error log without the units that are resolved or have failed anew, and the new failures."""
    gone = resolved.select("unit_id").unionByName(errors.select("unit_id")).distinct()
    return log.join(gone, "unit_id", "left_anti").unionByName(errors)

