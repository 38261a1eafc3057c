"""Hybrid retrieval of all queries in one plan: dense and sparse top-k, fusion, deduplication, role preference,
interleaving, cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..functions.text import resolve_role
from ..workspace import saved
from . import dense, rank, sparse
from .store import filtered


def hybrid(queries: DataFrame, passages: DataFrame, *, config: RetrievalConfig | None = None, filters: dict[str, object] | None = None, k: int | None = None, distance: str = "cosine", index: tuple[DataFrame, DataFrame] | None = None, near: DataFrame | None = None) -> DataFrame:
    """(query_id, pos, score, and the passage's columns) of the k best passages of each query.

    Queries: query_id, text, vector, role. Passages: id, text, vector, source, doc_type and others. Dense search takes
    the filters before its top-k, sparse search after (before, if the settings say so). ``near``: the result of dense
    search, where an index has it already.
    """
    c = config or RetrievalConfig()
    k = k or c.return_k
    near = near if near is not None else dense.top(queries, filtered(passages, filters), max(k, c.dense_k), distance=distance)
    pool = filtered(passages, filters) if c.prefilter_sparse else passages
    scored = sparse.search(queries, pool, max(k, c.sparse_k), index=None if c.prefilter_sparse and filters else index)
    if filters and not c.prefilter_sparse:
        scored = scored.join(filtered(passages, filters).select("id"), "id", "left_semi")
        scored = rank.renumbered(scored, "rank").withColumn("rank", F.col("pos")).drop("pos")
    lists = near.select("query_id", "id", F.lit(0).alias("list_no"), "rank").unionByName(scored.select("query_id", "id", F.lit(1).alias("list_no"), "rank"))
    fused = rank.fuse(lists, max(3 * k, 20), rrf_k=c.rrf_k).select("query_id", "id", "score", "pos")
    role = resolve_role(F.col("role")) if c.resolve_role else F.col("role")
    fused = saved(fused, "fused")
    hits = sparse.small(fused, fused.count())  # so that passages aren't shuffled for some lists of hits
    rows = passages.join(hits, "id").join(queries.select("query_id", role.alias("role")), "query_id")
    rows = rank.preferred_first(rank.deduplicated(rows), max(2 * k, 20))
    if c.interleave:
        rows = rank.interleaved(rows, complete=c.complete_interleave)
    return rows.where(F.col("pos") <= k)
