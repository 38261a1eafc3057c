"""What users ask, and what the documents have to say about it.

    python -m jobs.question_report --conversations DIR --documents DIR --out DIR

Every distinct question in the logs of conversations, however often it was asked, is searched for in the documents by
BM25. The report has its best documents, how often and in how many conversations it was asked, and is partitioned by how
well it is covered, so that those who write documents find the gaps in one folder:

    OUT/coverage=none/       questions that share no word with any document
    OUT/coverage=weak/       the best document's score is below ``weak_below`` for each word of the question
    OUT/coverage=answered/

The report replaces the one before; the same tables give the same report.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagemill.functions.text import normalize_text
from passagemill.operators import sparse
from passagemill.workspace import saved, shuffles_deleted

from .common import command, settings

log = logging.getLogger("question_report")

REPORT = "question_id string, question string, words long, asked long, conversations long, rank int, doc_id long, source string, score double, coverage string"


def questions(turns: DataFrame, role: str = "user") -> DataFrame:
    """(question_id, question, words, asked, conversations) of the distinct texts of a role; white space doesn't tell texts
    apart, and empty ones are none."""
    said = turns.where(F.lower("role") == role).select("conv_id", normalize_text(F.col("text")).alias("question")).where("question != ''")
    # First by conversation, so that a question that everybody asks is counted in many tasks.
    each = said.groupBy("question", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    asked = each.groupBy("question").agg(F.sum("n").alias("asked"), F.count("conv_id").alias("conversations"))
    return asked.select(F.sha2("question", 256).alias("question_id"), "question", F.size(F.split("question", " ")).cast("long").alias("words"), "asked", "conversations")


def one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each key. Only ids are shuffled to find those of several rows, and no texts but theirs."""
    twice = saved(docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "twice")
    n = twice.count()
    if n == 0:
        return docs
    twice = sparse.small(twice, n)
    return docs.join(twice, key, "left_anti").unionByName(docs.join(twice, key, "left_semi").dropDuplicates([key]))


def report(asked: DataFrame, documents: DataFrame, k: int, weak_below: float) -> DataFrame:
    """A row for each question and each of its ``k`` best documents, or one without any."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source").where("doc_id is not null")
    docs = one_of_each(docs)
    found = sparse.search(asked, docs, k, query_key="question_id", query_text="question", key="doc_id")
    found = found.join(docs.select("doc_id", "source"), "doc_id")
    best = F.max("score").over(Window.partitionBy("question_id"))
    coverage = F.when(F.col("best").isNull(), "none").when(F.col("best") < weak_below * F.col("words"), "weak").otherwise("answered")
    rows = asked.join(found, "question_id", "left").withColumn("best", best).withColumn("coverage", coverage)
    return rows.select("question_id", "question", "words", "asked", "conversations", "rank", "doc_id", "source", "score", "coverage")


def run(spark: SparkSession, conversations: str, documents: str, out: str, config: dict | None = None) -> None:
    """Write the report of all questions in the conversations.

    ``conversations``: Parquet of conv_id, role and text. ``documents``: Parquet of doc_id, text and source; of several
    rows of an id one counts.
    """
    config = settings("question_report") | (config or {})
    turns, docs = spark.read.parquet(conversations), spark.read.parquet(documents)
    asked = questions(turns, config["role"])
    made = report(asked, docs, config["k"], config["weak_below"])
    with shuffles_deleted(spark):
        made.repartition("coverage", "question_id").write.mode("overwrite").partitionBy("coverage").parquet(out)
    log.info("read %d turns from %s and %d documents from %s", turns.count(), conversations, docs.count(), documents)
    for row in read(spark, out).groupBy("coverage").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("question_id").alias("questions")).orderBy("coverage").collect():
        log.info("wrote %d rows, %d questions of coverage %s to %s", row["rows"], row["questions"], row["coverage"], out)


def read(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(out)


if __name__ == "__main__":
    command("question_report", {"conversations": "Parquet of conversations", "documents": "Parquet of documents", "out": "the report's folder"}, run)
