"""Approximate nearest neighbours by cross-polytope hashing.

Each table applies its own pseudo-rotation (three rounds of random signs and a fast Hadamard transform) to the unit
vectors; a vector's bucket is its nearest signed axis. Queries probe the nearest several signed axes of each table.
Repeated rows are indexed once. Candidates are scored exactly in double precision inside their bucket, block against
block; every block gives its k best ids per query, and the k best distinct ones of all tables are the result.

A bucket is a tuple of signed axes of independent rotations, and probes go by the sum of what they give away. How many
axes and probes is chosen by measured recall, at any size: SAMPLE queries are compared with all rows, and of the CHOICES
by which at least TARGET of their true neighbours share a bucket, the cheapest is taken (candidates scored, and rows of
probes dealt out). For neighbours that are hardly near, as among random vectors, that is one axis and many probes, whose
work grows with queries times rows; near ones allow tuples. Where no choice finds enough, as among random vectors of many
hundred dimensions, whose neighbours share nothing that a few axes could show, all queries are compared with all rows,
block by block. ``report`` says what was chosen, and the recall that was measured. Full buckets are met block by block, and
each pair of blocks may go to a task of its own. Queries that find fewer than k ids are compared with all rows, too.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components take no part; vectors of
different lengths never meet; a query's own id is never its neighbour; ties go to the smaller id; repeated rows of an
id count once, with the better score, and so do several vectors of a query's id; a query with fewer than k candidates
has all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import Workspace, batch_rows, saved

TABLES, SEED = 12, 20240229
#: Queries whose recall is measured, the share that must be found, and (axes of a bucket, probes of a table) to choose from;
#: if none finds enough, all rows are compared. A row that is dealt out costs as much as so many scored candidates.
SAMPLE, TARGET, ROW_COST = 64, 0.95, 100
CHOICES = ((3, 20), (3, 60), (3, 200), (2, 8), (2, 24), (2, 80), (2, 240), (1, 3), (1, 6), (1, 10), (1, 20), (1, 40), (1, 80))
BLOCK_ROWS = 1024


def _padded(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the columns; their length is a power of two."""
    d, n = x.shape
    h = 1
    while h < d:
        y = x.reshape(d // (2 * h), 2, h, n)
        x = np.empty_like(y)
        np.add(y[:, 0], y[:, 1], out=x[:, 0])
        np.subtract(y[:, 0], y[:, 1], out=x[:, 1])
        h *= 2
    return x.reshape(d, n)


def axes(unit: np.ndarray, table: int, hash_: int) -> np.ndarray:
    """Scores of the 2d signed axes (rows) after the pseudo-rotation of this table and hash, for each vector (columns)."""
    dim = _padded(unit.shape[1])
    signs = np.random.default_rng([SEED, dim, table, hash_]).choice([-1.0, 1.0], (3, dim, 1))
    x = np.zeros((dim, len(unit)))
    x[: unit.shape[1]] = unit.T
    for s in signs:
        x = hadamard(x * s) / np.sqrt(dim)
    return np.concatenate([x, -x])


def buckets(unit: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """For each row its ``probes`` best buckets, the best first."""
    n, dim = unit.shape
    size = 2 * _padded(dim)
    if probes == 1:
        key = np.zeros(n, np.int64)
        for h in range(hashes):
            key = key * size + axes(unit, table, h).argmax(axis=0)
        return key[:, None]
    best_key, best_loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
    for h in range(hashes):
        scores = np.ascontiguousarray(axes(unit, table, h).T)
        near = np.argsort(-scores, axis=1, kind="stable")[:, : min(probes, size)]
        top = np.take_along_axis(scores, near, axis=1)
        # What comes behind so many others in both lists that they fill the probes can't be among them.
        i, j = np.nonzero(np.multiply.outer(np.arange(1, best_key.shape[1] + 1), np.arange(1, near.shape[1] + 1)) <= probes)
        loss = best_loss[:, i] + (top[:, :1] - top)[:, j]
        order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        best_key = np.take_along_axis(best_key[:, i] * size + near[:, j], order, axis=1)
        best_loss = np.take_along_axis(loss, order, axis=1)
    return best_key


def scaled(x: np.ndarray) -> np.ndarray:
    """The rows in double precision, times powers of two that bring their largest components to 0.5 to 1, so that no
    square overflows or vanishes; cosines stay what they are, to the last bit."""
    x = np.ascontiguousarray(x, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, by the same sums wherever a row stands."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def valid_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v, dim) of the vectors that take part."""
    v = F.col("v")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("v"))
    return rows.where(F.col("id").isNotNull() & ok).withColumn("dim", F.size("v"))


def _hashed(rows: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """(dim, t, bucket, id, v): each row in its buckets (without hashes: in one), the vector packed as doubles or, if it
    came so, as floats."""
    kind = "<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 1024):
                batch = big.slice(lo, 1024)
                dims = batch["dim"].to_numpy(zero_copy_only=False)
                for dim in np.unique(dims):
                    some = batch.filter(pa.array(dims == dim))
                    x = some["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    unit = scaled(x)
                    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                    packed = pa.array([r.tobytes() for r in np.ascontiguousarray(x.astype(kind))], pa.binary())
                    for t in range(tables) if hashes else [0]:
                        keys = buckets(unit, t, hashes, max(probes, 1))
                        which = pa.array(np.repeat(np.arange(len(x)), keys.shape[1]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(keys.size, dim), pa.int32()), pa.array(np.full(keys.size, t), pa.int32()), pa.array(keys.reshape(-1)), some["id"].take(which), packed.take(which)], ["dim", "t", "bucket", "id", "v"])

    return rows.mapInArrow(run, "dim int, t int, bucket long, id long, v binary")


KEYS = ["dim", "t", "bucket"]


def _blocks(hashed: DataFrame, as_id: str, as_list: str) -> DataFrame:
    """(key, number, list, cells): lists of about BLOCK_ROWS rows of one bucket; a full bucket has several."""
    cells = hashed.groupBy(*KEYS).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("cells"))
    cell = F.pmod(F.xxhash64("id", "v"), F.col("cells")).cast("int").alias(as_id)
    return hashed.join(cells, KEYS).select(*KEYS, "cells", cell, F.struct("id", "v").alias("row")).groupBy(*KEYS, "cells", as_id).agg(F.collect_list("row").alias(as_list))


def _met(asked: DataFrame, found: DataFrame) -> DataFrame:
    """Each block of queries with each block of rows of its bucket. Blocks of rows stay one copy each, in the task of
    their own key and number; blocks of queries go to all numbers of their key."""
    asked, found = _blocks(asked, "i", "asked"), _blocks(found, "j", "found")
    cells = found.select(*KEYS, F.col("cells").alias("n")).distinct()
    left = asked.join(cells, KEYS).select(*KEYS, "asked", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    return left.join(found, [*KEYS, "j"]).select("asked", "found")


def _everywhere(rows: DataFrame) -> DataFrame:
    """The rows in one bucket for each length, packed as ``_hashed`` packs them."""
    return _hashed(rows, 0, 0, 0)


def found_at(pairs: list[tuple[np.ndarray, np.ndarray]], tables: int, hashes: int, probes: int) -> np.ndarray:
    """Of pairs (query, neighbour) how many probes a table needs until they share a bucket in some; ``probes`` + 1 if more
    than that. Pairs come by length, as two matrices."""
    out = [np.zeros(0, np.int64)]
    for asked, near in pairs:
        units = [x / np.sqrt((x * x).sum(axis=1, keepdims=True)) for x in (scaled(asked), scaled(near))]
        need = np.full(len(asked), probes + 1)
        for t in range(tables):
            met = buckets(units[0], t, hashes, probes) == buckets(units[1], t, hashes, 1)
            need = np.minimum(need, np.where(met.any(axis=1), met.argmax(axis=1) + 1, probes + 1))
        out.append(need)
    return np.concatenate(out)


def plan(pairs: list[tuple[np.ndarray, np.ndarray]], rows: int, tables: int = TABLES) -> tuple[int, int] | None:
    """Axes and probes for so many rows, by the recall of true neighbours; None if no choice reaches TARGET."""
    size = 2 * _padded(max((a.shape[1] for a, _ in pairs), default=1))
    cost = {(h, p): tables * p * (rows / size**h + ROW_COST) for h, p in CHOICES if p <= size**h}
    need = {h: found_at(pairs, tables, h, max(p for g, p in cost if g == h)) for h in {h for h, _ in cost}}
    good = [c for c in cost if len(need[c[0]]) == 0 or (need[c[0]] <= c[1]).mean() >= TARGET]
    return min(good, key=cost.get, default=None)


def _planned(asked: DataFrame, rows: DataFrame, k: int, kinds: list[str], tables: int, work: Workspace) -> tuple[int | None, int | None, float]:
    """Axes and probes (None, if all rows are to be compared) and their recall, by the exact neighbours of a sample of queries; SAMPLE times k pairs come to the driver."""
    some = work.saved(asked.orderBy(F.xxhash64("id", "v")).limit(SAMPLE), "sample")
    near = _nearest(_met(_everywhere(some), _everywhere(rows)), k, kinds)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id")
    left, right = (f.select(F.col("id").alias(c), F.col("v").cast("array<double>").alias(v), F.col("dim").alias(d)) for f, c, v, d in ((some, "query_id", "a", "da"), (rows, "vec_id", "b", "db")))
    met = near.join(left.dropDuplicates(["query_id"]), "query_id").join(right, "vec_id").where("da = db").dropDuplicates(["query_id", "vec_id"])
    found = met.select("da", "a", "b").collect()
    by_size = {d: [r for r in found if r["da"] == d] for d in {r["da"] for r in found}}
    pairs = [(np.array([r["a"] for r in some]), np.array([r["b"] for r in some])) for some in by_size.values()]
    chosen = plan(pairs, rows.count(), tables)
    if chosen is None:
        return None, None, 1.0
    return *chosen, float((found_at(pairs, tables, *chosen) <= chosen[1]).mean()) if pairs else 1.0


def search(vectors: DataFrame, queries: DataFrame | None = None, *, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", tables: int = TABLES, probes: int | None = None, hashes: int | None = None, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``queries`` (default: every vector). ``hashes``
    and ``probes`` are chosen if they aren't given; then ``report`` gets them (None: all rows are compared) and the recall
    on the sample."""
    rows = valid_vectors(vectors, vec_id, embedding).dropDuplicates(["id", "v"])
    asked = rows if queries is None else valid_vectors(queries, vec_id, embedding).dropDuplicates(["id", "v"])
    if (probes is None) != (hashes is None):
        raise ValueError("hashes and probes go together")
    spark = vectors.sparkSession
    kinds = ["<f4" if f.schema["v"].dataType.elementType.typeName() == "float" else "<f8" for f in (asked, rows)]
    with Workspace(spark) as work, batch_rows(spark, 16):
        if planned := hashes is None:
            hashes, probes, found = _planned(asked, rows, k, kinds, tables, work)
            if report is not None:
                report |= {"hashes": hashes, "probes": probes, "recall": found}
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        if planned and hashes is None:
            exact = _nearest(_met(_everywhere(asked), _everywhere(rows)), k, kinds)
            return saved(exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
        best = work.saved(_nearest(_met(work.saved(_hashed(asked, tables, hashes, probes), "probes"), work.saved(_hashed(rows, tables, hashes, 1), "index")), k, kinds), "best")
        enough = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        short = work.saved(asked.join(enough, F.col("id") == F.col("query_id"), "left_anti"), "short")
        if not short.isEmpty():
            exact = _nearest(_met(_everywhere(short), _everywhere(rows)), k, kinds)
            best = best.join(short, F.col("query_id") == F.col("id"), "left_anti").unionByName(exact)
        return saved(best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")


def _nearest(met: DataFrame, k: int, kinds: list[str]) -> DataFrame:
    """(query_id, vec_id, score): of each pair of blocks the k best ids for each query, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (q_ids, q), (ids, x) = (_unpacked(batch[c][row].values, kind) for c, kind in zip(("asked", "found"), kinds))
                wide_q, wide_x = scaled(q), scaled(x)
                a = wide_q / np.linalg.norm(wide_q, axis=1, keepdims=True)
                b = wide_x / np.linalg.norm(wide_x, axis=1, keepdims=True)
                guess = a @ b.T
                guess[q_ids[:, None] == ids[None, :]] = -np.inf
                order = np.argsort(ids, kind="stable")
                starts = np.flatnonzero(np.diff(ids[order], prepend=ids[order[0]] - 1))
                each = guess if len(starts) == len(ids) else np.maximum.reduceat(guess[:, order], starts, axis=1)  # the best of each id
                out = []
                for i in range(len(q_ids)):
                    g, of_id = guess[i], each[i]
                    floor = np.partition(of_id, len(of_id) - k)[len(of_id) - k] if len(of_id) > k else -np.inf
                    near = np.flatnonzero((g >= floor - 1e-9) & (g > -np.inf))
                    score = cosine(np.broadcast_to(wide_q[i], (len(near), q.shape[1])), wide_x[near])
                    _, first = np.unique(ids[near], return_index=True)  # a repeated row counts once
                    best = first[np.lexsort((ids[near][first], -score[first]))][:k]
                    out.append((np.full(len(best), q_ids[i]), ids[near][best], score[best]))
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    return met.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def _unpacked(list_: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    ids = list_.field("id").to_numpy(zero_copy_only=False)
    return ids, np.frombuffer(b"".join(list_.field("v").to_pylist()), kind).reshape(len(ids), -1)
