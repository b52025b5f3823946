"""Command line: dataset, index, enrich, retrieve, metrics, split, benchmark, ablation, tune-retrieval, visualize."""

from __future__ import annotations

import argparse
import json
import os
import platform
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .operators import enrichment, evaluation
from .operators.client import ServiceClient, ServiceSettings, read_dotenv
from .plans import experiments
from .plans.config import Settings
from .plans.context import hybrid_weights
from .plans.index import Extraction, Index, build_index, enrich_index
from .sources import datasets, files
from .storage import scratch

ALL_MODES = ["heuristic", "embedding", "hybrid", "two_stage", "iterative"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)

    def command(title: str, /, **options) -> None:
        c = sub.add_parser(title)
        for key, kw in options.items():
            c.add_argument("--" + key.replace("_", "-"), **kw)

    need, whole = {"required": True}, {"type": int}
    top = {"type": int, "default": 10}
    command("dataset", name={"choices": ["mixed", "paragraphs"], "default": "mixed"}, raw={"required": True, "nargs": "+"}, output=need, limit_docs=whole, limit_qa=whole)
    command(
        "index", input=need, output=need, chunk_size={"type": int, "default": 600}, overlap={"type": int, "default": 100}, extractor={"choices": ["rules", "llm"], "default": "rules"},
        max_llm_units=whole, no_resume={"action": "store_true"}, dotenv={"default": ".env"},
    )
    command("enrich", index=need, output=need, steps={"nargs": "*", "choices": enrichment.STEPS}, dotenv={"default": ".env"}, offline={"action": "store_true"})
    command(
        "retrieve", index=need, query=need, mode={"choices": ALL_MODES, "default": "two_stage"}, config={}, top_k=top, max_hops={"type": int, "default": 2},
        token_budget={"type": int, "default": 1200}, baseline={"action": "store_true"}, weights={},
    )
    command("metrics", index=need, qa=need, top_k=top, mode={"choices": ALL_MODES, "default": "two_stage"}, limit=whole, output={}, config={})
    command("split", qa=need, output=need, seed={"type": int, "default": 42})
    command("benchmark", index=need, enriched_index={}, qa=need, config={}, top_k=top, limit=whole, output={})
    command("ablation", index=need, enriched_index=need, qa=need, output=need, top_k=top, limit=whole, config={})
    command("tune-retrieval", index=need, dev_qa=need, output_config=need, top_k=top, limit=whole)
    command("visualize", index=need, output=need, max_nodes={"type": int, "default": 200})
    return p


def read_qa(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    qa = spark.read.parquet(path)
    return qa.orderBy("qid").limit(limit) if limit else qa


def rows(df: DataFrame) -> list[dict]:
    """Rows of a result of bounded size: a summary, or the ranking and context of one query."""
    return [r.asDict(recursive=True) for r in df.collect()]


def service(dotenv: str) -> ServiceClient:
    """The client that the environment describes; a file of variables, if it is there, goes before it."""
    told = read_dotenv(Path(dotenv).read_text(encoding="utf-8")) if Path(dotenv).is_file() else {}
    return ServiceClient(ServiceSettings.from_environment({**os.environ, **told}))


def run(spark: SparkSession, argv: list[str] | None = None) -> object:
    a = parser().parse_args(argv)
    if a.command == "dataset":
        docs, qa = datasets.normalize_paragraph_qa(datasets.read_raw(spark, a.raw[0]), a.limit_qa) if a.name == "paragraphs" else datasets.normalize_mixed(spark, a.raw, a.limit_docs, a.limit_qa)
        docs = datasets.evidence_first(docs, qa, a.limit_docs)
        docs.write.mode("overwrite").parquet(f"{a.output}/documents")
        qa.write.mode("overwrite").parquet(f"{a.output}/qa")
        value = rows(evaluation.evidence_coverage(qa, docs))[0]
        sinks.write_json(spark, f"{a.output}/dataset_manifest.json", value)
        return value
    if a.command == "index":
        how = Extraction()
        if a.extractor == "llm":
            client = service(a.dotenv)
            how = Extraction(client, a.output, not a.no_resume, a.max_llm_units, client.settings.continue_on_error)
        index = build_index(files.ingest(spark, a.input), a.chunk_size, a.overlap, how=how)
        index.save(a.output)
        told = {"extractor": a.extractor, "max_llm_units": a.max_llm_units, "resume": not a.no_resume, "python": platform.python_version(), **(how.stats or {})}
        told["llm_model"] = how.client.settings.model if how.client else None
        value = sinks.manifest(Index.load(spark, a.output), chunk_size=a.chunk_size, overlap=a.overlap, input=a.input, input_hash=sinks.input_hash(spark, a.input), **told)
        sinks.write_json(spark, f"{a.output}/manifest.json", value)
        return value["counts"] | (how.stats or {})
    if a.command == "enrich":
        answers = enrichment.Answers(spark, f"{a.output}/llm_answers")
        enrich_index(Index.load(spark, a.index), enrichment.RuleClient() if a.offline else service(a.dotenv), a.steps, answers).save(a.output)
        value = sinks.manifest(Index.load(spark, a.output), enriched=True, source_index=a.index, steps=a.steps or list(enrichment.STEPS))
        sinks.write_json(spark, f"{a.output}/manifest.json", value)
        return value["counts"]
    if a.command == "split":
        qa = read_qa(spark, a.qa).withColumn("evidence_count", F.size("evidence"))
        parts = evaluation.split(qa, a.seed)
        parts.write.mode("overwrite").partitionBy("split").parquet(a.output)
        return {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    index = Index.load(spark, a.index)
    if a.command == "visualize":
        return sinks.export_graph(spark, index, a.output, a.max_nodes)
    config = Settings.load(getattr(a, "config", None))
    if a.command == "retrieve":
        asked = spark.createDataFrame([("q", a.query)], "qid string, text string")
        ranked, context = experiments.retrieve(index, asked, a.mode, a.top_k, a.max_hops, a.token_budget, config, not a.baseline, hybrid_weights(spark, a.weights))
        return {"query": a.query, "mode": a.mode, "ranked_documents": [] if ranked is None else rows(ranked.orderBy("rank")), "context": rows(context.orderBy("place"))}
    qa = read_qa(spark, a.dev_qa if a.command == "tune-retrieval" else a.qa, a.limit)
    if a.command == "metrics":
        both, change = experiments.compare_calibrated(index, qa, mode=a.mode, top_k=a.top_k, config=config)
        value = {"summary": rows(both), "delta": rows(change)}
    elif a.command == "benchmark":
        value = {"summary": rows(experiments.benchmark(index, qa, Index.load(spark, a.enriched_index) if a.enriched_index else None, config, a.top_k)), "config": config.as_dict()}
    elif a.command == "ablation":
        table = experiments.ablation(index, Index.load(spark, a.enriched_index), qa, config=config, top_k=a.top_k)
        table.coalesce(1).write.mode("overwrite").csv(f"{a.output}/summary.csv", header=True)
        value = {"summary": rows(table), "config": config.as_dict()}
        a.output = f"{a.output}/summary.json"
    else:
        best, trials = experiments.tune(index, qa, a.top_k)
        value = best.as_dict()
        sinks.write_json(spark, f"{a.output_config}.trials.json", rows(trials))
        a.output = a.output_config
    if a.output:
        sinks.write_json(spark, a.output, value)
    return value


def main() -> None:
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    with scratch(spark):
        found = run(spark)
    print(json.dumps(found, ensure_ascii=False, indent=2, default=str))


if __name__ == "__main__":
    main()
