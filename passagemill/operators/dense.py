"""Exact top-k by vector similarity: numpy products of the broadcast queries with each Arrow batch of passages, k rows per
query and batch; a window takes the best of them. Queries that are too many to broadcast meet the passages block by block
(``blocks.msearch``), with the same result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .store import to_distance

#: Query vectors (components in all) that are broadcast.
BLOCK_COMPONENTS = 8_000_000


def similarity(a: Column, b: Column, distance: str) -> Column:
    """The score of two vector columns, higher is better: cosine, dot product, or minus the Euclidean distance."""
    kind = to_distance(distance)
    x, y = a.cast("array<double>"), b.cast("array<double>")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, t: s + t)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    if kind == "dot":
        return dot
    if kind == "l2":
        return -F.sqrt(total(F.zip_with(x, y, lambda p, q: (p - q) * (p - q))))
    return dot / (F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda q: q * q))))


def top(queries: DataFrame, passages: DataFrame, k: int, *, distance: str = "cosine", query_key: str = "query_id", key: str = "id", vector: str = "vector", by: str | None = None, digits: int = 6) -> DataFrame:
    """(query, key, score, rank) of the k most similar passages, or of those of each value of ``by``, which is then a
    column too; scores that agree to so many digits are ties, broken by key. Filter the passages before.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor zero vectors where the distance
    is cosine; vectors of different lengths never meet.
    """
    kind = to_distance(distance)
    spark = passages.sparkSession
    asked = queries.select(query_key, vector)
    carried = [key] if by is None else [key, by]
    rows = passages.select(*carried, F.col(vector).alias("vector"))
    schema = f"`{query_key}` {asked.schema[query_key].dataType.simpleString()}, " + "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carried) + "score double"

    some, size = [], 0
    for row in asked.where(F.col(vector).isNotNull()).toLocalIterator():
        some.append(row)
        if (size := size + len(row[1])) > BLOCK_COMPONENTS:
            return blocks.msearch(asked.withColumnRenamed(vector, "vector"), rows, k, kind=kind, query_key=query_key, key=key, by=by, digits=digits)
    vectors = pa.array([r[1] for r in some], pa.list_(pa.float64()))
    names = pa.array([r[0] for r in some])
    parts = {dim: (names.take(pa.array(at)), q) for dim, at, q in blocks.matrices(vectors, kind)}
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")
    shared = spark.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 4096):
                batch = big.slice(lo, 4096)
                coded = pa.array([0] * batch.num_rows) if by is None else batch[by]
                groups = coded.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                places = blocks.ranks(batch[key])
                for dim, valid, x in blocks.matrices(batch["vector"], kind):
                    if dim not in shared.value:
                        continue
                    asked_names, q = shared.value[dim]
                    scores = np.round(blocks.products(q, x, kind), digits)
                    for g in np.unique(groups[valid]):
                        at = np.flatnonzero(groups[valid] == g)
                        i, j = blocks.best(scores[:, at], places[valid[at]], k)
                        yield pa.RecordBatch.from_arrays([asked_names.take(pa.array(i)), *(batch[c].take(pa.array(valid[at[j]])) for c in carried), pa.array(scores[i, at[j]])], [query_key, *carried, "score"])

    said = rows.mapInArrow(run, schema).withColumn("score", F.round("score", digits))
    rank = F.row_number().over(Window.partitionBy(query_key, *carried[1:]).orderBy(F.desc("score"), key))
    return said.withColumn("rank", rank).where(F.col("rank") <= k)
