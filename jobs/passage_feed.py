"""Keeps a table of passages in step with a growing folder of documents.

    python -m jobs.passage_feed --documents DIR --out DIR --checkpoint DIR

A stream of the folder's Parquet files takes those that its checkpoint doesn't know yet, and ends when there are no more.
Of each micro-batch only documents that are new, or whose content differs from their newest known version, are cut into
passages; a document that comes again unchanged costs a look into the ledger. An empty text takes a document's passages
away.

    OUT/passages/batch=N/lang=XX/   passages of the documents that batch N brought or changed
    OUT/ledger/batch=N/             (doc_key, content) of these documents

A batch writes its own partitions, by dynamic overwrite and the ledger last, from its own rows and what the ledger said
before it. So a batch that is run again, after whatever failure, gives the same files; readers see a document's new
passages when its ledger row is there. ``current`` is the table of all documents' newest passages. Batches are numbered by
the checkpoint, so a new checkpoint needs a new OUT.

Keys and hashes of a batch are kept in the shared folder until it is done, so a cluster needs --scratch or
spark.checkpoint.dir.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.config import ChunkConfig
from passagemill.functions.text import normalize_text
from passagemill.operators.chunk import chunk
from passagemill.workspace import Workspace, saved, shuffles_deleted

from .common import command, settings

log = logging.getLogger("passage_feed")

LEDGER = "doc_key string, content string, batch long"
PASSAGES = "doc_key string, doc_id long, source string, id string, chunk_index int, chunk_total int, text string, batch long, lang string"


def _pattern(path: str) -> str:
    """A pattern that only this path matches: streams take a single file by pattern, and a folder as well."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows with what tells documents apart: the id, or without one the text. Languages are partitions, and so never
    null or empty."""
    lang = F.coalesce(F.when(F.col("lang") != "", F.col("lang")), F.lit("und")).alias("lang")
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text-"), F.sha2(normalize_text(F.col("text")), 256)))
    return rows.select(key.alias("doc_key"), F.col("doc_id").cast("long").alias("doc_id"), "text", "source", lang, *(c for c in rows.columns if c in ("modified", "file")))


def _content(rows: DataFrame) -> DataFrame:
    """The keyed rows with what tells a document's versions apart: a hash of all that passages are made of."""
    said = F.struct(normalize_text(F.col("text")).alias("text"), "source", "lang")
    return rows.withColumn("content", F.sha2(F.to_json(said, {"ignoreNullFields": "false"}), 256))


def _newest(ledger: DataFrame) -> DataFrame:
    """(doc_key, content, batch) of each document's newest version."""
    return ledger.groupBy("doc_key").agg(F.max(F.struct("batch", "content")).alias("v")).select("doc_key", "v.content", "v.batch")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _write(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def _taken(rows: DataFrame, seen: DataFrame, work: Workspace, once: int, others: int, repeated: int) -> DataFrame:
    """One row of each new or changed document: of those that came once (so many) as it is, found by the fewer of their keys
    and all others', which are broadcast if they are few, so that texts stay where they were read. Of repeated ones all rows
    are hashed again, for the version that counts."""
    alone = F.col("changed") & (F.col("n") == 1)
    fewer = work.saved(seen.where(alone if once <= others else ~alone).select("doc_key"), "fewer")
    taken = rows.join(fewer, "doc_key", "left_semi" if once <= others else "left_anti")
    if repeated:
        many = work.saved(seen.where("changed AND n > 1").select("doc_key", "content"), "many")
        mixed = _content(rows.join(many, "doc_key", "left_semi"))
        taken = taken.unionByName(mixed.join(many, ["doc_key", "content"], "left_semi").dropDuplicates(["doc_key"]).select(taken.columns))
    return taken


def take_batch(rows: DataFrame, number: int, out: str, config: dict) -> None:
    """Write what a micro-batch of documents (doc_id, text, source, lang, modified, file) brings or changes. Of several
    versions of a document in it the one in the newest file counts."""
    spark = rows.sparkSession
    rows = _keyed(rows)
    # The folder is there and has this schema from the first batch on, if only with no rows.
    empty = spark.createDataFrame([], LEDGER)
    empty.write.mode("append").partitionBy("batch").parquet(f"{out}/ledger")
    before = _newest(_table(spark, f"{out}/ledger", LEDGER).where(F.col("batch") < number)).select("doc_key", F.col("content").alias("was"))
    last = _content(rows).groupBy("doc_key").agg(F.max(F.struct("modified", "file", "content")).alias("v"), F.count(F.lit(1)).alias("n"))
    with Workspace(spark) as work:
        # Texts are hashed once: what was seen is written, and all that follows reads it.
        seen = last.join(before, "doc_key", "left").select("doc_key", "v.content", "n", F.coalesce(F.col("v.content") != F.col("was"), F.lit(True)).alias("changed"))
        seen = work.saved(seen, "seen")
        read, new, once, others, repeated = (x or 0 for x in seen.agg(F.sum("n"), *(F.count_if(c) for c in (F.col("changed"), F.expr("changed AND n = 1"), F.expr("NOT (changed AND n = 1)"), F.expr("changed AND n > 1")))).first())
        texts = _taken(rows, seen, work, once, others, repeated)
        cut = chunk(texts.select("doc_key", "doc_id", "source", "lang", "text", F.lit("").alias("doc_type")), ChunkConfig(size=config["size"], overlap=config["overlap"], min_text_len=config["min_text_len"], merge_short_tail=config["merge_short_tail"], technical_types=()))
        made = cut.select("doc_key", "doc_id", "source", F.col("hash_id").alias("id"), "chunk_index", "chunk_total", "text", F.lit(number).cast("long").alias("batch"), "lang")
        with shuffles_deleted(spark):
            _write(made, f"{out}/passages", "batch", "lang")
            _write(seen.where("changed").select("doc_key", "content", F.lit(number).cast("long").alias("batch")), f"{out}/ledger", "batch")
    m = _table(spark, f"{out}/passages", PASSAGES).where(F.col("batch") == number).count()
    log.info("batch %d: read %d rows; %d documents new or changed; wrote %d passages to %s", number, read, new, m, out)


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> int:
    """Take the documents that have come since the last run into the table of passages; how many micro-batches ran.

    ``documents``: a folder of Parquet files (doc_id, text, lang, source; other columns aren't read), or one such file.
    """
    config = settings("passage_feed") | (config or {})
    schema = spark.read.parquet(documents).select("doc_id", "text", "lang", "source").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["max_files_per_batch"]).parquet(_pattern(documents))
    stream = stream.select("*", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file"))
    ran: list[int] = []

    def batch(rows: DataFrame, number: int) -> None:
        take_batch(rows, number, out, config)
        ran.append(number)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s from where %s left off: %d batches", documents, checkpoint, len(ran))
    return len(ran)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The passages of each document's newest version. Those to leave out are found first, by their keys alone: they are
    few where most documents never changed, and then texts aren't shuffled."""
    newest = _newest(_table(spark, f"{out}/ledger", LEDGER)).select("doc_key", "batch")
    passages = _table(spark, f"{out}/passages", PASSAGES)
    stale = saved(passages.select("doc_key", "batch").distinct().join(newest, ["doc_key", "batch"], "left_anti"), "stale")
    return passages.join(stale, ["doc_key", "batch"], "left_anti").drop("doc_key", "batch")


if __name__ == "__main__":
    command("passage_feed", {"documents": "a folder of documents", "out": "where passages and ledger are", "checkpoint": "where the stream keeps its place"}, run)
