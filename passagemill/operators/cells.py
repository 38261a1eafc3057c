"""An exact index for vector search: inverted cells with bounds.

Cells are the clusters of a k-means fit (Spark's own, on a bounded sample of rows; every row is indexed). Each row is kept
in the cell of its nearest centre, as a partition of a Parquet table; of each cell the centre c, the number of rows and the
largest distance r of a row from c are known. For a question q no row of the cell scores more than

    q . c + |q| r               where the score is a dot product, or the cosine, with all vectors at length 1
    -max(|q - c| - r, 0)        where it is minus the Euclidean distance

So a search first visits each question's best cells until they hold k rows, takes the k-th best score found as a
threshold, and then visits the cells whose bound reaches it. No other cell is read, and the result is that of reading all.

Clustered vectors leave most cells unread; vectors without any structure leave none, and cost the first visits more than a
scan. Centres are few (``MAX_CELLS``), so they are what the driver holds; questions and rows meet in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace, batch_bytes, saved
from . import blocks

#: Rows of a cell, on average, up to so many cells; rows of the sample for each cell; rounds of k-means.
CELL_ROWS, MAX_CELLS, SAMPLE_ROWS, ROUNDS, SEED = 1024, 4096, 64, 5, 17
#: Rows of one cell that one task meets the cell's questions with.
LANE_ROWS = 1 << 16
#: Bounds are taken so much higher, for what rounding may do to scores.
MARGIN = 2e-6
#: Rows of visits that are made at once.
VISITS = 8192
#: Distances between rows and centres that are held at once.
DISTANCES = 1 << 20


def nearest_centres(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, some rows at a time, so that few distances are held at once."""
    step = max(1, DISTANCES // len(c))
    square = (c * c).sum(1)[None, :]
    return np.concatenate([(square - 2 * u[lo : lo + step] @ c.T).argmin(axis=1) for lo in range(0, len(u), step)])


def _placed(rows: DataFrame, key: str, vector: str, kind: str, dim: int, centres: np.ndarray) -> DataFrame:
    """(key, vector, cell, away) of the rows that take part: their nearest centre and how far it is away."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, at, x in blocks.matrices(batch["vector"], kind):
                if n == dim:
                    c = shared.value
                    u = blocks.units(x) if kind == "cosine" else x
                    cell = nearest_centres(u, c)
                    away = np.sqrt(((u - c[cell]) ** 2).sum(axis=1))
                    some = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([some["id"], some["vector"], pa.array(cell, pa.int32()), pa.array(away)], ["id", "vector", "cell", "away"])

    source = rows.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    types = [source.schema[c].dataType.simpleString() for c in ("id", "vector")]
    return source.mapInArrow(run, f"id {types[0]}, vector {types[1]}, cell int, away double")


def _fit(rows: DataFrame, n: int, key: str, vector: str, kind: str, dim: int, cells: int) -> np.ndarray:
    """Centres of a k-means fit on about SAMPLE_ROWS rows for each cell, picked by a hash of their keys."""
    if cells == 1:
        return np.zeros((1, dim))
    every = max(1, n // (SAMPLE_ROWS * cells))
    some = rows.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, x in blocks.matrices(batch[vector], kind):
                if size == dim:
                    u = blocks.units(x) if kind == "cosine" else x
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * dim, pa.int32()), pa.array(u.reshape(-1)))], ["u"])

    with Workspace(rows.sparkSession) as work:
        sample = work.saved(some.select(key, vector).mapInArrow(run, "u array<double>"), "sample")
        model = KMeans(k=cells, maxIter=ROUNDS, seed=SEED, initSteps=2, featuresCol="u").fit(sample.select(array_to_vector("u").alias("u")))
        return np.array(model.clusterCenters())


def build(rows: DataFrame, path: str, *, dim: int, kind: str = "cosine", key: str = "id", vector: str = "vector", cell_rows: int = CELL_ROWS) -> None:
    """Index the rows' vectors of length ``dim`` below ``path``: ``rows`` by cell, and ``cells``."""
    spark = rows.sparkSession
    rows = rows.select(key, vector).where(F.size(vector) == dim)
    n = rows.count()
    centres = _fit(rows, n, key, vector, kind, dim, int(np.clip(n // cell_rows, 1, MAX_CELLS)))
    placed = _placed(rows, key, vector, kind, dim, centres)
    # By range of cell and key, so that a cell of very many rows is written by several tasks.
    placed.repartitionByRange("cell", "id").write.partitionBy("cell").parquet(f"{path}/rows")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    made = spark.read.schema(schema).parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    at = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    made.join(F.broadcast(at), "cell").select("cell", "n", "radius", "centre").coalesce(1).write.parquet(f"{path}/cells")


@dataclass(frozen=True)
class Bounds:
    """What is known of the cells."""

    kind: str
    cells: np.ndarray
    n: np.ndarray
    radius: np.ndarray
    centres: np.ndarray

    def of(self, q: np.ndarray) -> np.ndarray:
        """For each question (down) and cell (across) a score that no row of the cell passes."""
        if self.kind == "l2":
            d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (self.centres**2).sum(1)[None, :] - 2 * q @ self.centres.T, 0))
            return -np.maximum(d - self.radius, 0)
        q = blocks.units(q) if self.kind == "cosine" else q
        return q @ self.centres.T + np.sqrt((q * q).sum(1))[:, None] * self.radius

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Whether each question visits each cell at first: the best ones, until they hold k rows."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        held = np.cumsum(self.n[order], axis=1)
        wanted = np.zeros(bounds.shape, bool)
        np.put_along_axis(wanted, order, held - self.n[order] < k, axis=1)
        return wanted


def _visits(asked: DataFrame, known: Bounds, k: int, second: bool) -> DataFrame:
    """(query, cell, vector) of the first visits of questions (query, vector), or of the others that their thresholds
    (column bar; null: none) leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, VISITS // len(known.cells))
        for big in batches:
            for lo in range(0, big.num_rows, step):
                batch = big.slice(lo, step)
                for n, at, q in blocks.matrices(batch["vector"], known.kind):
                    if n != known.centres.shape[1]:
                        continue
                    b = known.of(q)
                    wanted = known.first(b, k)
                    if second:
                        bar = batch["bar"].to_numpy(zero_copy_only=False)[at]
                        wanted = ~wanted & ~(b + MARGIN * np.maximum(1, np.abs(b)) < bar[:, None])
                    i, j = np.nonzero(wanted)
                    some = batch.take(pa.array(at[i]))
                    yield pa.RecordBatch.from_arrays([some["query"], pa.array(known.cells[j], pa.int32()), some["vector"]], ["query", "cell", "vector"])

    types = [asked.schema[c].dataType.simpleString() for c in ("query", "vector")]
    return asked.mapInArrow(run, f"query {types[0]}, cell int, vector {types[1]}")


class Cells:
    """An index, as ``build`` left it. ``without``: ids (column id) that count no more."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "cosine", without: DataFrame | None = None) -> None:
        self.spark, self.path, self.without = spark, path, without
        found = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])  # MAX_CELLS at most
        column = lambda c, kind: np.array([r[c] for r in found], kind)
        self.known = Bounds(kind, column("cell", np.int64), column("n", np.int64), column("radius", float), column("centre", float))
        #: Cells that the last search read.
        self.read: set[int] = set()

    def _rows(self, cells: list[int]) -> DataFrame:
        """The index's rows (id, vector, cell) in these cells; other partitions aren't read."""
        rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col("cell").isin(cells)).select("id", "vector", "cell")
        return rows if self.without is None else rows.join(self.without.select("id"), "id", "left_anti")

    def _met(self, visits: DataFrame, k: int, digits: int, schema: str) -> DataFrame:
        """The best rows of the cells that questions visit, in blocks: rows once, questions to all lanes of their cells."""
        known = self.known
        cells = sorted(r["cell"] for r in visits.select("cell").distinct().collect())  # MAX_CELLS at most
        self.read |= set(cells)
        lanes = dict(zip(known.cells.tolist(), (1 + known.n // LANE_ROWS).tolist()))
        table = F.broadcast(self.spark.createDataFrame([(c, lanes[c]) for c in cells], "cell int, lanes int"))
        rows = blocks.packed(self._rows(cells), "id", "vector", known.kind, "ids", "x", "cell").join(table, "cell")
        rows = rows.withColumn("lane", F.pmod(F.xxhash64("ids"), F.col("lanes")).cast("int")).drop("lanes")
        # By range, so that a cell that very many questions visit is packed by several tasks.
        asked = blocks.packed(visits.repartitionByRange("cell", "query"), "query", "vector", known.kind, "asked", "q", "cell").join(table, "cell")
        asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).drop("lanes")
        return blocks.scored(rows.join(asked, ["cell", "lane", "dim"]), k, known.kind, digits, schema)

    def search(self, queries: DataFrame, k: int, *, query_key: str = "query_id", vector: str = "vector", digits: int = 6) -> DataFrame:
        """(query, id, score, rank), as ``dense.top`` over all rows."""
        self.read = set()
        key = queries.schema[query_key].dataType.simpleString()
        if not len(self.known.cells):
            return self.spark.createDataFrame([], f"`{query_key}` {key}, id string, score double, rank int")
        schema = f"`{query_key}` {key}, id {self.spark.read.parquet(f'{self.path}/rows').schema['id'].dataType.simpleString()}, score double"
        with Workspace(self.spark) as work, batch_bytes(self.spark):
            asked = work.saved(queries.select(F.col(query_key).alias("query"), F.col(vector).alias("vector")), "asked")
            visits = work.saved(_visits(asked, self.known, k, False), "first")
            found = work.saved(self._met(visits, k, digits, schema), "found")
            bar = blocks.ranked(found, k, query_key, "id").where(F.col("rank") == k).select(F.col(query_key).alias("query"), F.col("score").alias("bar"))
            more = work.saved(_visits(asked.join(bar, "query", "left"), self.known, k, True), "second")
            if not more.isEmpty():
                found = found.unionByName(work.saved(self._met(more, k, digits, schema), "more"))
            return saved(blocks.ranked(found, k, query_key, "id").select(query_key, "id", "score", "rank"), "nearest")


def search(indexes: list[Cells], queries: DataFrame, k: int, *, query_key: str = "query_id", **options) -> DataFrame:
    """The best of several indexes whose ids are distinct."""
    parts = [c.search(queries, k, query_key=query_key, **options).drop("rank") for c in indexes if len(c.known.cells)]
    if not parts:
        return indexes[0].search(queries, k, query_key=query_key, **options)
    return blocks.ranked(reduce(DataFrame.unionByName, parts), k, query_key, "id")
