from pyspark.sql import functions as F

from passagemill.llm import bloom


def test_never_denies_a_member_and_seldom_claims_others(spark):
    ids = spark.createDataFrame([(i * i - 50,) for i in range(5000)] + [(None,)], "id long")
    words = bloom.build(ids)
    batch = spark.range(-50, 5_000_000, 499).select("id", *bloom.hashes(F.col("id"))).toArrow().combine_chunks().to_batches()[0]
    hit = bloom.maybe(words, batch)
    members = {i * i - 50 for i in range(5000)}
    inside = [x in members for x in batch["id"].to_pylist()]
    assert all(h for h, i in zip(hit, inside) if i) and sum(hit) <= sum(inside) + 5
    assert bloom.maybe(bloom.build(ids.limit(0)), batch).sum() == 0
