"""Rows of a store that are laid out by a column: filters skip files and row groups, and find what they found before."""

import pytest
from pyspark.sql import functions as F

from passagemill.config import StoreConfig
from passagemill.operators import store


def rows(spark, n=4000):
    """A third of all rows have one kind."""
    kind = F.when(F.col("n") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.xxhash64("n") % 40 + 40).cast("string")))
    name = F.sha2(F.col("n").cast("string"), 256)
    return spark.range(n).withColumnRenamed("id", "n").select(F.col("n").cast("string").alias("id"), F.concat(F.lit("some words "), name).alias("text"), F.lit(None).cast("array<float>").alias("vector"), F.col("n").alias("ingest_seq"), kind.alias("kind"), name.alias("name"))


def read(df):
    """How many rows the scans below a plan gave, once it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        metric = leaf.metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """A store without layout and one with, of the same rows."""
    out = []
    for name, layout in (("plain", {}), ("laid", {"sort_by": ("kind",), "bloom": ("name",), "row_group_bytes": 4096})):
        s = store.PassageStore(spark, StoreConfig(path=str(tmp_path_factory.mktemp(name)), dim=4, **layout))
        assert s.upsert(rows(spark)) == 4000
        out.append(s)
    return out


@pytest.mark.parametrize("by", [{"kind": "k41"}, {"kind": "hot"}, {"kind": None}, {"kind": "no such kind"}, {"kind": "hot", "id": "3"}])
def test_same_rows_less_read(both, by):
    plain, laid = (store.filtered(s.rows(), by) for s in both)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, laid.select(plain.columns).collect()))
    n = plain.count()
    assert n <= read(laid) <= max(1.6 * n, 400)
    assert n == 0 or read(laid) < read(plain)


def test_bloom_filters_skip_row_groups_without_order(both, spark):
    one = rows(spark).where("id = '77'").first()
    found = store.filtered(both[1].rows(), {"name": one["name"]})
    assert [r["id"] for r in found.collect()] == ["77"]
    assert 0 < read(found) < 2000


def test_replaced_rows_and_merges_keep_the_layout(spark, tmp_path):
    s = store.PassageStore(spark, StoreConfig(path=str(tmp_path), dim=4, sort_by=("kind",), row_group_bytes=4096, merge_share=0.4))
    s.upsert(rows(spark))
    s.upsert(rows(spark).where("kind = 'k41'").withColumn("kind", F.lit("moved")))
    assert store.filtered(s.rows(), {"kind": "k41"}).count() == 0
    moved = rows(spark).where("kind = 'k41'").count()
    assert store.filtered(s.rows(), {"kind": "moved"}).count() == moved > 0
    s.upsert(rows(spark).where("kind != 'k41'"))  # more than the share: one part again
    assert len(s._parts(s.resolve())) == 1
    found = store.filtered(s.rows(), {"kind": "moved"})
    assert found.count() == moved and moved <= read(found) < 1000


def test_nothing_written(spark, tmp_path):
    s = store.PassageStore(spark, StoreConfig(path=str(tmp_path), dim=4, sort_by=("kind",), bloom=("name",)))
    assert s.upsert(rows(spark, 0)) == 0 and s.rows() is None
