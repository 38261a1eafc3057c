"""BM25 from an index of posting blocks: questions read their terms' buckets, and of these only the ranges that can matter.

Documents are dealt by a hash of their id to ranges of some RANGE_DOCS each. A block holds one term's postings in one
range, with the largest term frequency and the least length in it, which bound what the term can give any of its
documents. Blocks lie in partitions by a hash of the term, sorted by term. Beside them are each term's number of
documents, partitioned alike, how many terms have each such number (for the mean of their idf), and the corpus' totals.

A search sums, for each question and range, its terms' bounds. The k best ranges hold k documents at least; these are
scored in full, and the k-th best score is a threshold. Then the ranges whose bound reaches it are scored. No other
block's documents are read, no posting of other buckets, and the result is that of ``sparse.search``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import Workspace, saved
from . import sparse

#: Partitions by term: as many as ranges, but no more than this; documents of a range, on average.
BUCKETS, RANGE_DOCS = 256, 128
#: Tasks that a bucket's postings are dealt to when they are written.
SHARES = 8


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(docs: DataFrame, path: str, *, key: str = "id", text: str = "text") -> None:
    """Index documents of distinct keys below ``path``: ``blocks``, ``terms``, ``counts``, ``totals``."""
    spark = docs.sparkSession
    with Workspace(spark) as work:
        rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.size(sparse._words(text)).cast("long").alias("len"))
        totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("words"), F.lit(rows.schema["id"].dataType.simpleString()).alias("id_type"))
        ranges = F.greatest(F.lit(1), F.floor(F.col("n") / RANGE_DOCS)).cast("int")
        totals = totals.withColumn("ranges", ranges).withColumn("buckets", F.least("ranges", F.lit(BUCKETS)))
        totals.write.parquet(f"{path}/totals")
        row = spark.read.parquet(f"{path}/totals").first()
        ranges, buckets = row["ranges"], row["buckets"]
        at = F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int").alias("range")
        posted = sparse.postings(rows, keep=("len",)).select("term", _bucket(F.col("term"), buckets).alias("bucket"), at, F.struct("id", "tf", "len").alias("p"))
        # One shuffle, by the bucket and a share of its ranges, so that a frequent term's postings are dealt out.
        posted = posted.withColumn("share", F.col("range") % SHARES).repartition("bucket", "share")
        made = posted.groupBy("bucket", "share", "term", "range")
        made = made.agg(F.count(F.lit(1)).alias("n"), F.max("p.tf").alias("most"), F.min("p.len").alias("shortest"), F.collect_list("p").alias("postings"))
        blocks = made.drop("share").sortWithinPartitions("bucket", "term", "range")
        blocks.write.partitionBy("bucket").parquet(f"{path}/blocks")
        terms = spark.read.schema("term string, n long, bucket int").parquet(f"{path}/blocks").groupBy("bucket", "term").agg(F.sum("n").alias("df"))
        terms = work.saved(terms, "terms")
        terms.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
        terms.groupBy("df").agg(F.count(F.lit(1)).alias("terms")).coalesce(1).write.parquet(f"{path}/counts")


class Postings:
    """An index, as ``build`` left it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        totals = spark.read.parquet(f"{path}/totals").first()
        self.id_type = totals["id_type"]
        self.buckets = totals["buckets"]
        self.n, self.mean_length = totals["n"], totals["words"] / totals["n"] if totals["n"] else 1.0
        counts = spark.read.parquet(f"{path}/counts").agg(F.sum(F.col("terms") * self._raw(F.col("df"))).alias("raw"), F.sum("terms").alias("terms")).first()
        #: The mean of all terms' idf before the floor.
        self.mean = counts["raw"] / counts["terms"] if counts["terms"] else math.nan

    def _raw(self, df: Column) -> Column:
        return F.log(F.lit(self.n) - df + 0.5) - F.log(df + 0.5)

    def _gain(self, tf: Column, length: Column) -> Column:
        """What a term gives a document, without the term's own weight."""
        return tf * (sparse.K1 + 1) / (tf + sparse.K1 * (1 - sparse.B + sparse.B * length / (self.mean_length or 1.0)))

    def blocks(self, buckets: list[int], *columns: str) -> DataFrame:
        """The blocks in these buckets: other partitions and columns aren't read."""
        return self.spark.read.parquet(f"{self.path}/blocks").where(F.col("bucket").isin(buckets)).select("bucket", "term", "range", *columns)

    def search(self, queries: DataFrame, k: int, *, query_key: str = "query_id", query_text: str = "text", digits: int = sparse.DIGITS) -> DataFrame:
        """(query, id, score, rank) of the k best documents of each query."""
        q = query_key
        if math.isnan(self.mean):  # no terms at all
            return self.spark.createDataFrame([], f"`{q}` {queries.schema[q].dataType.simpleString()}, id {self.id_type}, score double, rank int")
        with Workspace(self.spark) as work:
            asked = work.saved(sparse._asked(queries, q, query_text).withColumn("bucket", _bucket(F.col("term"), self.buckets)), "asked")
            buckets = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())  # BUCKETS at most
            known = self.spark.read.parquet(f"{self.path}/terms").where(F.col("bucket").isin(buckets))
            raw = self._raw(F.col("df"))
            idf = F.when(raw < 0, F.lit(sparse.EPSILON * self.mean)).otherwise(raw)
            terms = work.saved(asked.join(known, ["bucket", "term"]).select(q, "bucket", "term", (F.col("times") * idf).alias("weight")), "terms")
            most = F.greatest(F.col("weight") * self._gain(F.col("most"), F.col("shortest")), F.lit(0.0))
            ranges = self.blocks(buckets, "most", "shortest").join(terms, ["bucket", "term"]).groupBy(q, "range").agg(F.sum(most).alias("bound"))
            place = F.row_number().over(Window.partitionBy(q).orderBy(F.desc("bound"), "range"))
            ranges = work.saved(ranges.withColumn("place", place), "ranges")

            def scored(some: DataFrame) -> DataFrame:
                wanted = terms.join(some.select(q, "range"), q)
                hits = self.blocks(buckets, "postings").join(wanted, ["bucket", "term", "range"])
                each = hits.select(q, "weight", F.explode("postings").alias("p")).select(q, "weight", "p.*")
                return each.groupBy(q, "id").agg(F.sum(F.col("weight") * self._gain(F.col("tf"), F.col("len"))).alias("score"))

            found = work.saved(scored(ranges.where(F.col("place") <= k)), "found")
            bar = sparse.top(found, k, q, "id", digits).where(F.col("rank") == k).select(q, F.col("score").alias("bar"))
            rest = ranges.where(F.col("place") > k).join(bar, q, "left").where(F.coalesce(F.col("bound") >= F.col("bar") - sparse.MARGIN, F.lit(True)))
            found = found.unionByName(scored(rest))
            return saved(sparse.top(found, k, q, "id", digits), "bm25")
