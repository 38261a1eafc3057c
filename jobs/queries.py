"""The jobs as queries over the given tables, and SQL for what they leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagemill.plans.oracle import bm25_cte, chunk_ctes, hash_id, norm
from passagemill.workspace import scratch

from . import passage_feed, question_report


def job1_passage_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark, "job1")
    for _ in range(2):  # the second run finds nothing new
        passage_feed.run(spark, f"{sf_dir}/documents.parquet", f"{base}/out", f"{base}/checkpoint")
    return passage_feed.current(spark, f"{base}/out")


def job2_question_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "job2")
    for _ in range(2):
        question_report.run(spark, f"{sf_dir}/conversations.parquet", f"{sf_dir}/documents.parquet", out)
    return question_report.read(spark, out)


QUERIES = {f.__name__: f for f in (job1_passage_feed, job2_question_report)}

_q = norm("text")
ORACLE = {
    "job1_passage_feed": f"""
WITH RECURSIVE {chunk_ctes(())}
SELECT c.doc_id, c.source, {hash_id("c.text", "coalesce(nullif(c.source, ''), 'unknown')", "'0'")} AS id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(chunk_total AS INTEGER) AS chunk_total, c.text, coalesce(nullif(d.lang, ''), 'und') AS lang
FROM chunks c JOIN documents d ON d.doc_id = c.doc_id
""",
    "job2_question_report": f"""
WITH q AS (SELECT {_q} AS question, count(*) AS asked, count(DISTINCT conv_id) AS conversations FROM conversations WHERE lower(role) = 'user' AND {_q} <> '' GROUP BY {_q}),
asked AS (SELECT sha256(question) AS query_id, question AS text FROM q),
{bm25_cte("documents", "doc_id")},
best AS (SELECT query_id, max(score) AS best FROM said GROUP BY query_id),
w AS (SELECT *, sha256(question) AS query_id, CAST(len(string_split(question, ' ')) AS BIGINT) AS words FROM q)
SELECT w.query_id AS question_id, question, words, asked, conversations, CAST(rank AS INTEGER) AS rank, id AS doc_id, source, score,
  CASE WHEN best IS NULL THEN 'none' WHEN best < 1.0 * words THEN 'weak' ELSE 'answered' END AS coverage
FROM w LEFT JOIN (SELECT * FROM said WHERE rank <= 5) s USING (query_id) LEFT JOIN best USING (query_id) LEFT JOIN documents ON doc_id = id
""",
}
