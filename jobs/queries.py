"""The jobs as registered queries: each runs its job twice into a new folder and gives what is there then; and the SQL of that."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import graph_stream, question_report
from tessera import queries as library
from tessera.storage import shared_dir


def job1_question_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = f"{shared_dir(spark)}/question-report-{uuid.uuid4().hex}"
    for _ in range(2):
        question_report.run(spark, f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet", output)
    return spark.read.parquet(f"{output}/report")


def job2_graph_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/graph-stream-{uuid.uuid4().hex}"
    for _ in range(2):
        graph_stream.run(spark, f"{sf_dir}/documents.parquet", f"{base}/graph", f"{base}/checkpoint")
    edges = spark.read.parquet(f"{base}/graph/edges")
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), "|").alias(c)
    return edges.select(
        "id", "source", "target", "relation", "weight", "evidence_text", "evidence_type", "conflict_status", listed("text_unit_ids"), listed("source_docs"), "combined_degree",
        "evidence_score", "ontology_score", "structural_score", "consistency_score", "reliability",
    )


JOB1_SQL = f"""{library.BODY_SQL},
{library.GOLD_SQL},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 10),
ng AS (SELECT qid, count(*) AS n_evidence FROM (SELECT DISTINCT qid, id FROM gold) GROUP BY 1),
h AS (SELECT t.qid, t.id, t.rank, t.score, g.id IS NOT NULL AS hit FROM top t LEFT JOIN (SELECT DISTINCT qid, id FROM gold) g ON g.qid = t.qid AND g.id = t.id),
per AS (
  SELECT qid, count(*) AS n_seen, count(*) FILTER (hit) AS n_hits, min(rank) FILTER (hit) AS first_hit, coalesce(sum(1 / log2(rank + 1)) FILTER (hit), 0.0) AS dcg, max(score) AS best_score,
         string_agg(id::VARCHAR, ',' ORDER BY rank) AS found, string_agg(id::VARCHAR, ',' ORDER BY rank) FILTER (hit) AS evidence_found
  FROM h GROUP BY 1),
j AS (SELECT b.item_id AS qid, n_evidence, per.* EXCLUDE (qid) FROM benchmark b LEFT JOIN ng ON ng.qid = b.item_id LEFT JOIN per ON per.qid = b.item_id)
SELECT CASE WHEN n_evidence > 0 THEN 'evaluated' ELSE 'null' END AS status, qid, coalesce(n_evidence, 0)::BIGINT AS n_evidence, coalesce(n_hits, 0)::BIGINT AS n_hits,
       coalesce(found, '') AS found, coalesce(evidence_found, '') AS evidence_found, first_hit::INTEGER AS first_hit, best_score,
       CASE WHEN n_evidence > 0 THEN round(coalesce(n_hits, 0) / n_evidence::DOUBLE, 6) END AS recall_at_k,
       CASE WHEN n_evidence > 0 THEN round(coalesce(n_hits, 0) / greatest(1, coalesce(n_seen, 0))::DOUBLE, 6) END AS precision_at_k,
       CASE WHEN n_evidence > 0 THEN round(coalesce(1.0 / first_hit, 0.0), 6) END AS mrr,
       CASE WHEN n_evidence > 0 THEN round(coalesce(dcg, 0.0) / list_sum(list_transform(range(1, least(n_evidence, 10) + 1), lambda i: 1 / log2(i + 1))), 6) END AS ndcg_at_k
FROM j"""

JOB2_SQL = f"""WITH {library.CALIBRATED_SQL}
SELECT id, source, target, relation, weight, evidence_text, evidence_type, conflict_status, array_to_string(text_unit_ids, '|') AS text_unit_ids,
       array_to_string(source_docs, '|') AS source_docs, combined_degree, evidence_score, ontology_score, structural_score, consistency_score, reliability
FROM cal"""

QUERIES = {f.__name__: f for f in (job1_question_report, job2_graph_stream)}
SQL = {"job1_question_report": JOB1_SQL, "job2_graph_stream": JOB2_SQL}
