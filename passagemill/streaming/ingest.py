"""Incremental ingest, of streams and by comparing states.

Streams: each micro-batch of documents is chunked and upserted by id, so a repeated batch changes nothing.

States: what a source holds is compared by a hash of its documents with what the store has of it. Sources that are new or
changed are chunked, passages of those that changed or are gone are deleted, in one version of the store; what is the same
is neither chunked nor written. Only sources and hashes are shuffled for the comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ChunkConfig
from ..functions.text import normalize_text, resolved_source
from ..operators.chunk import chunk
from ..operators.store import PassageStore
from ..workspace import saved


def passages(docs: DataFrame, config: ChunkConfig | None = None, *, corpus_id: str = "default", seq: int = 0) -> DataFrame:
    """Chunks as store rows: id, text, vector (null unless given), metadata, and ingest_seq, which orders them by batch and
    by place in it."""
    made = chunk(docs, config).withColumnRenamed("hash_id", "id")
    if "vector" not in made.columns:
        made = made.withColumn("vector", F.lit(None).cast("array<float>"))
    given = F.col("corpus_id") if "corpus_id" in made.columns else F.lit(None).cast("string")
    return made.withColumns({"corpus_id": F.coalesce(given, F.lit(corpus_id)), "ingest_seq": F.struct(F.lit(seq).cast("long").alias("batch"), F.monotonically_increasing_id().alias("row"))})


def content(text: Column, page: Column) -> Column:
    """What tells a document's versions apart."""
    return F.sha2(F.concat(F.coalesce(page.cast("string"), F.lit("")), F.lit("|"), normalize_text(text)), 256)


def states(rows: DataFrame, key: str = "source", said: str = "content") -> DataFrame:
    """(key, state): a hash of the distinct contents of each key, of 128 bits and their number. It adds up in any order, so
    a key with very many rows is summed in many tasks."""
    hashes = [F.bit_xor(F.xxhash64(F.col(said), F.lit(k))).cast("string") for k in (1, 2)]
    return rows.select(key, said).distinct().groupBy(key).agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *hashes).alias("state"))


def differences(before: DataFrame, after: DataFrame, key: str = "source") -> DataFrame:
    """(key, change) of keys that were added, changed or removed between two ``states``."""
    both = before.select(key, F.col("state").alias("old")).join(after.select(key, F.col("state").alias("new")), key, "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(key, change.alias("change"))


def sync(docs: DataFrame, store: PassageStore, config: ChunkConfig | None = None, *, corpus_id: str = "default", seq: int = 0, prepared: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Bring a corpus of the store to the state of ``docs``: all its documents, as they are now. ``prepared`` gives new
    passages what they lack, as vectors. Returns (source, change), of a written table."""
    config = config or ChunkConfig()
    has = lambda c, kind: F.col(c) if c in docs.columns else F.lit(None).cast(kind)
    source = resolved_source(has("source", "string"), has("file_name", "string"))
    docs = docs.withColumn("source", source).withColumn("content", content(F.col("text"), has("page_number", "int")))
    docs = docs.where(F.length(normalize_text(F.col("text"))) >= config.min_text_len)  # others have no passages
    rows = store.rows()
    have = None if rows is None or "content" not in rows.columns else rows.where(F.col("corpus_id") == corpus_id)
    before = docs.select("source", "content").limit(0) if have is None else have.select("source", "content")
    changes = saved(differences(states(before), states(docs)), "changes")
    if changes.isEmpty():
        return changes
    # All that an empty store is given is new, and need not be dealt out to be found so.
    fresh = docs if have is None else docs.join(changes.where("change != 'removed'").select("source"), "source", "left_semi")
    made = passages(fresh, config, corpus_id=corpus_id, seq=seq)
    made = made if prepared is None else prepared(made.drop("vector"))
    stale = changes.where("change != 'added'").select("source")
    gone = changes.sparkSession.createDataFrame([], "id string") if have is None else have.join(stale, "source", "left_semi").select("id")
    store.exchange(made, gone)
    return changes


def start(stream: DataFrame, store: PassageStore, checkpoint: str, *, config: ChunkConfig | None = None, corpus_id: str = "default", available_now: bool = True) -> StreamingQuery:
    """Run a stream of documents into a store."""

    def batch(rows: DataFrame, number: int) -> None:
        store.upsert(passages(rows, config, corpus_id=corpus_id, seq=number))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
