"""Which questions does a corpus answer, and how well are the answers found?

A batch job for those who keep a set of questions (or passages whose source is sought) and a collection of documents.
For every question it finds the documents that hold its passage word for word (the evidence), ranks the collection by
BM25, and measures the ranking against the evidence.  The report has a row a question, in partitions by ``status``:
``evaluated`` (there is evidence) or ``null`` (there is none, so nothing should be found); a second table sums it up.

    python -m jobs.question_report --questions Q --documents D --output O [--config jobs/question_report.json]

O/report and O/summary are overwritten; a rerun on the same input writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import Counter, log, main, settings
from tessera.operators import evaluation, scoring
from tessera.storage import materialize, scratch

DEFAULTS = {"question_id": "item_id", "question_text": "text", "document_id": "doc_id", "document_text": "text", "top_k": 10}
RATES = ("recall_at_k", "precision_at_k", "mrr", "ndcg_at_k")


def report_rows(questions: DataFrame, documents: DataFrame, top_k: int) -> DataFrame:
    """(status, qid, n_evidence, n_hits, found, evidence_found, first_hit, best_score, RATES) of questions (qid, text) over documents (id, text).

    ``found``: the ranked documents, ``evidence_found``: those of them that are evidence, both as ids joined by commas.  Rates of questions
    without evidence are null.
    """
    gold = materialize(evaluation.containing(questions.withColumnRenamed("qid", "pid"), documents).select(F.col("pid").alias("qid"), "id").distinct(), "evidence")
    ranked = materialize(scoring.bm25_top_k(documents, questions, ["qid"], top_k), "ranked")
    order = F.struct(-F.col("score"), F.col("id"))
    listed = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(order)).alias("l"), F.max("score").alias("best_score"))  # ``top_k`` rows a question
    places = listed.select("qid", F.posexplode("l").alias("p", "x")).select("qid", (F.col("p") + 1).alias("rank"), F.array("x.id").alias("ids"))
    hits = places.select("qid", "rank", F.col("ids")[0].alias("id")).join(gold, ["qid", "id"]).groupBy("qid")
    hits = hits.agg(F.count("*").alias("n_hits"), F.min("rank").cast("int").alias("first_hit"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("e"))
    measured = evaluation.question_metrics(places, gold, top_k).select("qid", *[F.round(c, 6).alias(c) for c in RATES])
    many = gold.groupBy("qid").agg(F.count("*").alias("n_evidence"))
    full = questions.select("qid").join(many, "qid", "left").join(listed, "qid", "left").join(hits, "qid", "left").join(measured, "qid", "left")
    joined = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return full.withColumn("l", F.transform("l", lambda x: x["id"])).select(
        F.when(F.col("n_evidence") > 0, "evaluated").otherwise("null").alias("status"), "qid", number("n_evidence"), number("n_hits"),
        joined("l").alias("found"), joined("e").alias("evidence_found"), "first_hit", "best_score", *RATES,
    )


def run(spark: SparkSession, questions: str, documents: str, output: str, config: str | None = None) -> dict:
    """Writes the report on the questions at one path over the documents at another; gives the numbers of rows read and written."""
    c = settings(spark, config, DEFAULTS)
    read = {"questions": Counter("questions"), "documents": Counter("documents")}
    asked = spark.read.parquet(questions).select(F.col(c["question_id"]).alias("qid"), F.col(c["question_text"]).alias("text"))
    docs = spark.read.parquet(documents).select(F.col(c["document_id"]).alias("id"), F.col(c["document_text"]).alias("text"))
    with scratch(spark):
        asked = materialize(read["questions"].of(asked), "questions")
        told = spark.read.parquet(documents).agg(F.count("*")).first()[0]  # from the files' footers
        wrote = Counter("report")
        rows = wrote.of(report_rows(asked, docs, int(c["top_k"])))
        rows.repartition("status", F.pmod(F.xxhash64("qid"), F.lit(64))).write.mode("overwrite").partitionBy("status").parquet(f"{output}/report")
    report = spark.read.parquet(f"{output}/report")
    summary = report.groupBy("status").agg(F.count("*").alias("questions"), *[F.avg(x).alias(x) for x in RATES])
    summary.coalesce(1).write.mode("overwrite").parquet(f"{output}/summary")  # a row a status
    counts = {"questions": read["questions"].rows, "documents": told, "rows": wrote.rows}
    log.info("read %(questions)d questions and %(documents)d documents, wrote %(rows)d rows", counts)
    for r in spark.read.parquet(f"{output}/summary").collect():
        log.info("%s", r.asDict())
    return counts


if __name__ == "__main__":
    main(run, {"questions": "Parquet table of questions", "documents": "Parquet table of documents", "output": "folder for the tables report and summary"})
