"""Ranked lists: reciprocal rank fusion, first-per-key deduplication, role preference, interleaving, cuts. Every operator
works on all queries at once, in windows by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The document types that a role prefers, and the two classes that interleaving alternates.
ROLE_TYPES = {
    "developer": ("technical", "schema", "erd", "reference", "api"),
    "ba": ("functional", "product", "analytics", "reporting"),
    "new_joiner": ("product", "onboarding", "user_guide", "how_to"),
}
TECHNICAL = ("technical", "schema", "erd", "api", "reference")
FUNCTIONAL = ("functional", "product", "analytics", "reporting", "user_guide")

#: Characters of a text that tell it from others of its source.
HEAD = 80


def fuse(lists: DataFrame, k: int, *, rrf_k: int = 60, query: str = "query_id", key: str = "id", list_no: str = "list_no", rank: str = "rank", digits: int = 12) -> DataFrame:
    """(query, key, score, first_list, first_rank, pos): the sum of 1 / (rrf_k + rank) over all appearances; ties go to
    what appears first, by list, then rank. Positions count from 1."""
    first = F.min(F.struct(F.col(list_no).alias("l"), F.col(rank).alias("r"))).alias("first")
    summed = lists.groupBy(query, key).agg(F.round(F.sum(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(rank))), digits).alias("score"), first)
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "first.l", "first.r"))
    out = summed.select(query, key, "score", F.col("first.l").alias("first_list"), F.col("first.r").alias("first_rank"), place.alias("pos"))
    return out.where(F.col("pos") <= k)


def renumbered(rows: DataFrame, *order: Column | str, query: str = "query_id") -> DataFrame:
    """Positions from 1 in this order."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def deduplicated(rows: DataFrame, *, query: str = "query_id", source: str = "source", text: str = "text", head: int = HEAD) -> DataFrame:
    """The first row of each source and beginning of text; null is a source like others."""
    same = Window.partitionBy(query, source, F.substring(F.coalesce(F.col(text), F.lit("")), 1, head)).orderBy("pos")
    return renumbered(rows.withColumn("same_", F.row_number().over(same)).where("same_ = 1").drop("same_"), "pos", query=query)


def preferred_first(rows: DataFrame, k: int, *, role: str = "role", doc_type: str = "doc_type", query: str = "query_id", types: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows whose type the role prefers go first, otherwise in order; the first k. Roles are names as they are, in any
    case: an alias has no preference unless it was resolved."""
    likes = F.lit(False)
    for name, some in (types or ROLE_TYPES).items():
        likes |= (F.lower(F.col(role)) == name) & F.col(doc_type).isin(*some)
    return renumbered(rows, F.desc(F.coalesce(likes, F.lit(False))), "pos", query=query).where(F.col("pos") <= k)


def interleaved(rows: DataFrame, *, doc_type: str = "doc_type", query: str = "query_id", complete: bool = False) -> DataFrame:
    """Functional and technical rows in turn, functional first; a query without one of the classes stays as it is.

    Other types are passed over; then, if rows are missing, those at the positions after the number taken are appended,
    whatever they are, so rows can repeat and others be lost. ``complete`` appends the passed-over ones instead.
    """
    kind = F.when(F.col(doc_type).isin(*FUNCTIONAL), 0).when(F.col(doc_type).isin(*TECHNICAL), 1)
    whole = Window.partitionBy(query)
    at = rows.withColumn("kind_", kind)
    at = at.withColumns({"f_": F.count(F.when(F.col("kind_") == 0, 1)).over(whole), "t_": F.count(F.when(F.col("kind_") == 1, 1)).over(whole)})
    at = at.withColumn("turn_", F.row_number().over(Window.partitionBy(query, "kind_").orderBy("pos")))
    mixed = (F.col("f_") > 0) & (F.col("t_") > 0)
    turns = at.where(mixed & F.col("kind_").isNotNull()).withColumn("key_", F.struct(F.lit(0).alias("a"), F.col("turn_").alias("b"), F.col("kind_").alias("c")))
    tail = F.col("kind_").isNull() if complete else F.col("pos") > F.col("f_") + F.col("t_")
    rest = at.where(mixed & tail | ~mixed).withColumn("key_", F.struct(F.lit(1).alias("a"), F.col("pos").alias("b"), F.lit(0).alias("c")))
    return renumbered(turns.unionByName(rest), "key_", query=query).drop("kind_", "f_", "t_", "turn_", "key_")
