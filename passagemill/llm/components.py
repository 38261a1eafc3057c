"""Connected components of a distributed edge list.

Each round hooks every node to the neighbour of least priority (a hash that changes with the round, so that paths and
stars shrink alike), contracts the edges and drops those inside a group, in DataFrame operations. Once few edges are
left, a single task contracts them. Nodes and edges never reach the driver; each round's tables are cut off by writing
them. Nulls and loops in the edges connect nothing.
"""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace, saved, scratch, shared_dir  # noqa: F401


def renamed(carried: list[str], results) -> list[str]:
    """Names for carried columns that differ from those of the results: ``_input`` is put behind those that clash."""
    taken, out = {*results, *carried}, []
    for name in carried:
        if name in results:
            while name in taken:
                name += "_input"
            taken.add(name)
        out.append(name)
    return out


#: Rows that go to Python at once, where rows are whole texts.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """From now on this session sends no more than TEXT_ROWS rows to Python at once: a batch is held several times over
    on both sides, and rows here are whole texts. Queries do this, as plans take the setting when they run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """What runs inside sends so many rows to Python at once: for rows that hold lists."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: So many edges at most are contracted in one task (some 200 bytes each there); more in distributed rounds, until few
#: are left.
TASK_EDGES = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes in the edges; the component is the smallest node. Nodes are of any type that has
    an order and a hash."""
    with Workspace(edges.sparkSession) as work:
        return saved(labelled(edges, work, a, b), "components")


def labelled(edges: DataFrame, work: Workspace, a: str = "a", b: str = "b", task_edges: int = TASK_EDGES) -> DataFrame:
    """As ``components``, from tables that go with ``work``."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a != b")
    pairs = work.saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots: DataFrame | None = None
    for turn in itertools.count():
        n = pairs.count()
        if n == 0:
            break
        if n <= task_edges:
            hooks = work.saved(_contracted(pairs), "hooks")
        else:
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            ranked = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))
            hooks = both.groupBy("a").agg(F.min(ranked("b")).alias("least")).select(F.col("a").alias("v"), F.least(F.col("least"), ranked("a"))["v"].alias("to"))
            hooks = work.saved(hooks, "hooks")
        if roots is None:
            roots = hooks.select(F.col("v").alias("node"), F.col("to").alias("root"))
        else:
            roots = work.saved(roots.join(hooks, roots.root == hooks.v, "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        if n <= task_edges:
            break
        left = pairs.join(hooks, pairs.a == hooks.v).select(F.col("to").alias("x"), "b")
        moved = left.join(hooks, left.b == hooks.v).select("x", F.col("to").alias("y")).where("x != y")
        pairs = work.saved(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if roots is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")


def _contracted(pairs: DataFrame) -> DataFrame:
    """(v, to) of all nodes of few edges, where ``to`` is one node for each component: hooks and pointer jumps in numpy."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        coded = pa.chunked_array([*table["a"].chunks, *table["b"].chunks]).combine_chunks().dictionary_encode()
        ends = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(2, -1)
        root = np.arange(len(coded.dictionary))
        while True:
            x, y = root[ends[0]], root[ends[1]]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != (up := root[root])).any():
                root = up
        yield pa.RecordBatch.from_arrays([coded.dictionary, coded.dictionary.take(pa.array(root))], ["v", "to"])

    return pairs.coalesce(1).mapInArrow(run, f"v {kind}, to {kind}")
