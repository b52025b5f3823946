"""Evaluation runs: retrieval modes, baseline comparison, benchmark, ablation and tuning."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation
from ..storage import materialize
from .config import Settings
from .context import MODES, candidate_context, document_context
from .index import Index
from .iterative import retrieve_iterative
from .ranking import abstains, rank_documents

EVALUATION_BUDGET = 1600
# The signals of the ablation variants on an enriched index.
SIGNALS = (
    (), ("questions",), ("summaries",), ("entities",), ("inferred_edges",), ("importance",), ("contradiction_penalty",),
    ("questions", "summaries"), ("questions", "summaries", "entities"), ("questions", "summaries", "importance"),
    ("questions", "summaries", "entities", "inferred_edges"), ("questions", "summaries", "entities", "inferred_edges", "importance", "contradiction_penalty"),
)


def retrieve(index: Index, queries: DataFrame, mode: str = "hybrid", top_k: int = 10, max_hops: int = 2, budget: int = 1200, config: Settings | None = None, calibrated: bool = True, weights: dict[str, float] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(ranked documents or None, context) of all queries (qid, text) in one of the modes."""
    config = config or Settings()
    if mode in MODES:
        return None, candidate_context(index, queries, mode, top_k, max_hops, budget, config, calibrated, weights)
    if mode not in ("two_stage", "iterative"):
        raise ValueError("mode must be heuristic, embedding, hybrid, two_stage or iterative")
    rank = rank_documents if mode == "two_stage" else retrieve_iterative
    ranked = materialize(rank(index, queries, config, calibrated, top_k).select("qid", "id", "rank", "score", "title", "snippet"), "ranked")
    return ranked, document_context(index.visible(calibrated, config.uses("use_inferred_edges")), queries, ranked, budget, max_hops, config)


def evaluate(index: Index, qa: DataFrame, mode: str = "two_stage", top_k: int = 10, config: Settings | None = None, calibrated: bool = True) -> DataFrame:
    """Details of each question of ``qa`` (qid, text, answer, evidence, question_type): status, metrics, answer hit, abstention."""
    config = config or Settings()
    queries = qa.where(F.col("text") != "").select("qid", "text")
    ranked, context = retrieve(index, queries, mode, top_k, budget=EVALUATION_BUDGET, config=config, calibrated=calibrated)
    context = materialize(context, "context")
    gold = evaluation.gold_documents(qa, index.documents)
    places = context.select("qid", F.col("place").alias("rank"), F.col("document_ids").alias("ids"))
    if ranked is not None:
        places = ranked.select("qid", "rank", F.array(F.col("id").cast("string")).alias("ids"))
    text_gold = gold.select("qid", F.col("id").cast("string").alias("id"))
    told = evaluation.evidence_status(qa, gold).join(evaluation.question_metrics(places, text_gold, top_k), "qid", "left")
    told = told.join(evaluation.packed_recall(context, text_gold), "qid", "left").join(evaluation.answer_hits(context, qa), "qid", "left")
    silent = abstains(ranked, queries, config) if ranked is not None else queries.select("qid", F.lit(False).alias("abstained"))
    return told.join(silent, "qid").join(qa.select("qid", F.coalesce("question_type", F.lit("unknown")).alias("question_type")), "qid")


def summary(details: DataFrame) -> DataFrame:
    """One row: the mean metrics of the evaluated questions, skips, answer hit rate and abstention on questions without evidence."""
    done = evaluation.summarize(details.where("status = 'evaluated'"))
    null = F.col("status") == "null"
    rest = details.agg(
        F.count("*").alias("total_qa"), F.count_if(F.col("status") != "evaluated").alias("skipped_without_evidence"), F.count_if(null).alias("skipped_null_queries"),
        F.count_if(F.col("status") == "incomplete").alias("skipped_incomplete_evidence"),
        F.round(F.coalesce(F.avg(F.when(null, F.col("abstained").cast("double"))), F.lit(0.0)), 6).alias("null_abstention_accuracy"),
        F.round(F.coalesce(F.avg(F.when((F.col("status") == "evaluated") & F.col("answer_evaluable"), F.coalesce("answer_hit", F.lit(0.0)))), F.lit(0.0)), 6).alias("answer_hit_rate"),
        F.count_if((F.col("status") == "evaluated") & F.col("answer_evaluable")).alias("answer_evaluated_count"),
    )
    return done.crossJoin(F.broadcast(rest))  # one row each


def timed_summary(index: Index, qa: DataFrame, name: str, **options) -> DataFrame:
    """``summary`` with the variant's name and the seconds that the whole table of questions took."""
    began = time.perf_counter()
    out = materialize(summary(evaluate(index, qa, **options)).withColumn("variant", F.lit(name)), "summary")
    return out.withColumn("seconds", F.lit(round(time.perf_counter() - began, 3)))


def compare_calibrated(index: Index, qa: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(summaries of baseline and calibrated, their difference)."""
    both = timed_summary(index, qa, "baseline", calibrated=False, **options).unionByName(timed_summary(index, qa, "calibrated", calibrated=True, **options))
    return both, evaluation.delta(both, "variant", "baseline", (*evaluation.METRICS[:5], "answer_hit_rate")).where("variant = 'calibrated'")


def benchmark(index: Index, qa: DataFrame, enriched: Index | None = None, config: Settings | None = None, top_k: int = 10) -> DataFrame:
    """Summaries of two-stage retrieval: baseline, calibrated and, if given, enriched."""
    runs = [("baseline_two_stage", index, False), ("calibrated_two_stage", index, True)] + [("enriched_two_stage", enriched, True)] * (enriched is not None)
    out = None
    for name, own, calibrated in runs:
        s = timed_summary(own, qa, name, mode="two_stage", calibrated=calibrated, config=config, top_k=top_k)
        out = s if out is None else out.unionByName(s)
    return out


def ablation_variants() -> list[tuple[str, bool, bool, tuple[str, ...], str]]:
    """(name, on the enriched index, calibrated, signals, mode) of the 28 variants."""
    base = [("baseline_base_index", False, False, ()), ("calibrated_base_index", False, True, ())]
    for s in SIGNALS:
        base.append(("enriched_control_no_fields" if not s else "all_enrichment_fields" if len(s) == 6 else "+".join(s), True, True, s))
    return [(*v, "two_stage") for v in base] + [(f"iterative_{v[0]}", *v[1:], "iterative") for v in base]


def ablation(index: Index, enriched: Index, qa: DataFrame, errors: DataFrame | None = None, config: Settings | None = None, top_k: int = 10, strict: bool = True, names: set[str] | None = None) -> DataFrame:
    """One summary per variant, with its difference to calibrated_base_index (columns delta_*).

    ``errors`` (document_id, ...): extraction failures; if one hits evidence and ``strict`` is set, the variants count as
    invalid and all their metrics are 0.  ``names`` restricts the variants.
    """
    config = config or Settings()
    failed = evaluation.failed_evidence(errors, qa, index.documents).count() if errors is not None else 0
    out = None
    for name, on_enriched, calibrated, signals, mode in ablation_variants():
        if names and name not in names:
            continue
        own = replace(config.with_signals(signals))
        s = timed_summary(enriched if on_enriched else index, qa, name, mode=mode, calibrated=calibrated, config=own, top_k=top_k)
        if failed and strict:
            s = s.withColumns({m: F.lit(0.0) for m in (*evaluation.METRICS, "answer_hit_rate", "null_abstention_accuracy")})
        s = s.withColumns({"signals": F.lit("+".join(signals)), "retrieval_mode": F.lit(mode), "calibrated": F.lit(calibrated), "valid": F.lit(not (failed and strict)), "failed_evidence_units": F.lit(failed)})
        out = s if out is None else out.unionByName(s)
    deltas = evaluation.delta(out, "variant", "calibrated_base_index").toDF("variant", *[f"delta_{m}" for m in evaluation.METRICS])
    return out.join(deltas, "variant", "left").na.fill(0.0, [f"delta_{m}" for m in evaluation.METRICS])


def tuning_configs() -> list[Settings]:
    """The six configurations that are tried."""
    plain = Settings(use_dense=False, use_reranker=False, use_graph=False, use_enrichment=False)
    ranked = replace(plain, use_dense=True, use_reranker=True)
    rich = replace(ranked, use_enrichment=True)
    return [plain, replace(plain, use_dense=True), ranked, rich, replace(rich, use_graph=True), replace(rich, weights=rich.weights | {"enrichment": 0.10})]


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the best (success, recall, mrr, speed); the first of equals."""
    return trials.orderBy(F.desc("all_evidence_success_at_k"), F.desc("recall_at_k"), F.desc("mrr"), "seconds", "trial").limit(1)


def tune(index: Index, qa: DataFrame, top_k: int = 10) -> tuple[Settings, DataFrame]:
    """(best configuration, all trials)."""
    configs = tuning_configs()
    trials = None
    for i, c in enumerate(configs):
        s = timed_summary(index, qa, f"trial_{i}", mode="two_stage", config=c, top_k=top_k).withColumn("trial", F.lit(i))
        trials = s if trials is None else trials.unionByName(s)
    return configs[best_trial(trials).first()["trial"]], trials
