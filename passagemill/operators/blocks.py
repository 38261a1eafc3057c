"""Vector search as a join of blocks: blocks of questions meet blocks of passages, one matrix product each.

Passages are packed into blocks where they are read, and each block is shuffled once, to a lane; blocks of questions go to
all lanes. Nothing passes through the driver, and neither side is held whole anywhere. Each pair of blocks gives k rows a
question; a window takes the best of them.

Vectors that are null, empty, or hold null or non-finite components take no part, nor zero vectors where the distance is
cosine; vectors of different lengths never meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import batch_bytes, saved

BLOCK_ROWS = 1024
#: Bytes of known best scores that a task holds, about.
KNOWN_BYTES = 64 << 20


def matrices(column: pa.Array, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of the vectors that take part, for each length."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null is no number
    starts = np.cumsum(n) - n
    for dim in np.unique(n[n > 0]).tolist():
        at = np.flatnonzero(n == dim)
        x = flat.reshape(-1, dim) if len(at) * dim == len(flat) else flat[starts[at][:, None] + np.arange(dim)]
        ok = np.isfinite(x).all(axis=1)
        if kind == "cosine":
            ok &= x.any(axis=1)
        if ok.any():
            yield dim, at[ok], x[ok]


def units(x: np.ndarray) -> np.ndarray:
    """The rows at length 1, whatever their size: brought near 1 by powers of two first."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def products(q: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    """Scores of all rows of q (down) with all rows of x (across), higher is better."""
    if kind == "l2":
        return -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0))
    return units(q) @ units(x).T if kind == "cosine" else q @ x.T


def best(scores: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best scores of each row, ties by place."""
    n = min(k, scores.shape[1])
    floor = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
    i, j = np.nonzero(scores >= floor[:, None])
    if len(i) > n * len(scores):  # ties at the end
        order = np.lexsort((places[j], -scores[i, j], i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, np.arange(len(scores)))
        keep = np.arange(len(i)) - first[i] < n
        i, j = i[keep], j[keep]
    return i, j


def above(q: np.ndarray, x: np.ndarray, places: np.ndarray, bars: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and cosines of the k best of each row that reach its bar: products in single precision, whose error is
    bounded, leave few pairs to be measured in double precision."""
    q, x = units(q), units(x)
    error = (q.shape[1] + 8) * float(np.finfo(np.float32).eps) + 10.0**-digits
    floor = np.where(np.isfinite(bars), bars - error, -2.0).astype(np.float32)
    i, j = np.nonzero(q.astype(np.float32) @ x.astype(np.float32).T >= floor[:, None])
    score = np.empty(len(i))
    for lo in range(0, len(i), 1 << 16):
        some = slice(lo, lo + (1 << 16))
        score[some] = np.einsum("ij,ij->i", q[i[some]], x[j[some]])
    score = np.round(score, digits)
    order = np.lexsort((places[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(q)))[i] < k
    return i[keep], j[keep], score[keep]


def ranks(keys: pa.Array) -> np.ndarray:
    """The place of each key in their order."""
    places = np.empty(len(keys), np.int64)
    places[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
    return places


def packed(rows: DataFrame, key: str, vector: str, kind: str, ids: str, data: str, group: str | None = None) -> DataFrame:
    """(dim, ids, data and the group, if there is one): blocks of at most BLOCK_ROWS rows of one length and group."""
    key_type = rows.schema[key].dataType.simpleString()
    more = "" if group is None else f", `{group}` {rows.schema[group].dataType.simpleString()}"
    size = BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros(batch.num_rows, np.int64) if group is None else batch[group].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            for dim, at, x in matrices(batch[vector], kind):
                for code in np.unique(codes[at]):
                    some = np.flatnonzero(codes[at] == code)
                    for lo in range(0, len(some), size):
                        part = some[lo : lo + size]
                        names = batch[key].take(pa.array(at[part]))
                        columns = [pa.array([dim], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), names), pa.array([x[part].tobytes()], pa.binary())]
                        if group is not None:
                            columns.append(batch[group].take(pa.array(at[part[:1]])))
                        yield pa.RecordBatch.from_arrays(columns, ["dim", ids, data, *([] if group is None else [group])])

    return rows.mapInArrow(run, f"dim int, {ids} array<{key_type}>, {data} binary{more}")


def scored(pairs: DataFrame, k: int, kind: str, digits: int, schema: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """(question, key, score, and what is carried) of the k best of each question in each pair of blocks (dim, asked, q, ids, x).
    ``schema``: of the result."""
    names = [part.split()[0].strip("`") for part in schema.split(", ")]
    room = KNOWN_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}  # the k best scores so far of each question of a block
        held = 0
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch["dim"][row].as_py()
                asked, ids = batch["asked"][row].values, batch["ids"][row].values
                q, x = (np.frombuffer(batch[c][row].as_buffer(), np.float64).reshape(-1, dim) for c in ("q", "x"))
                block = (dim, len(asked), asked[0].as_py(), zlib.crc32(batch["q"][row].as_buffer()), *(batch[c][row].as_py() for c in carried))
                tops = known.get(block)
                if tops is not None and kind == "cosine":
                    i, j, score = above(q, x, ranks(ids), tops.min(1), k, digits)
                else:
                    said = np.round(products(q, x, kind), digits)
                    i, j = best(said, ranks(ids), k)
                    score = said[i, j]
                new = np.full((len(asked), k), -np.inf)
                first = np.searchsorted(i, np.arange(len(asked)))
                new[i, np.arange(len(i)) - first[i]] = score
                known.pop(block, None)  # the newest stands last
                known[block] = new if tops is None else np.partition(np.concatenate([tops, new], axis=1), k, axis=1)[:, k:]
                held += new.nbytes if tops is None else 0
                while held > room and len(known) > 1:  # what is forgotten only spares less work
                    held -= known.pop(next(iter(known))).nbytes
                more = [batch[c].take(pa.array(np.full(len(i), row))) for c in carried]
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(i)), ids.take(pa.array(j)), pa.array(score), *more], names)

    return pairs.mapInArrow(run, schema)


def ranked(found: DataFrame, k: int, query_key: str, key: str, *groups: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query_key, *groups).orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def msearch(queries: DataFrame, passages: DataFrame, k: int, *, kind: str = "cosine", query_key: str = "query_id", key: str = "id", vector: str = "vector", by: str | None = None, digits: int = 6, lanes: int | None = None) -> DataFrame:
    """(query, key, score, rank) as ``dense.top``, for any number of questions."""
    spark = passages.sparkSession
    # All questions go to each lane, so that lanes are as many as can be at work, and no more with more input.
    lanes = lanes or min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    carried = () if by is None else (by,)
    asked = packed(queries.select(query_key, vector), query_key, vector, kind, "asked", "q")
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    rows = packed(passages.select(key, *carried, vector), key, vector, kind, "ids", "x", by)
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    schema = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, `{key}` {passages.schema[key].dataType.simpleString()}, score double" + "".join(f", `{c}` {passages.schema[c].dataType.simpleString()}" for c in carried)
    with batch_bytes(spark):
        found = saved(scored(rows.join(asked, ["dim", "lane"]), k, kind, digits, schema, carried), "msearch")
    return ranked(found, k, query_key, key, *carried).select(query_key, key, *carried, "score", "rank")
