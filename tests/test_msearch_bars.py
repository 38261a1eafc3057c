"""Blocks of vectors leave out what k better ones are known for already."""

import numpy as np
from pyspark.sql import functions as F

from passagemill.operators import blocks, dense


def test_pairs_of_blocks_give_less_and_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    x[300:340] = x[7]  # copies: ties by id
    x[340:360] *= 1e-30
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, vector array<double>, label int")
    asked = rows.select(F.col("id").alias("query_id"), "vector")
    emitted, before = [], blocks.saved
    monkeypatch.setattr(blocks, "saved", lambda df, what: emitted.append((made := before(df, what)).count()) or made)
    got = sorted(tuple(r) for r in blocks.msearch(asked, rows, 5, lanes=1).collect())
    want = sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in dense.top(asked, rows, 5).collect())
    assert [(a, b, round(s, 6), r) for a, b, s, r in got] == [(a, b, round(s, 6), r) for a, b, s, r in want]
    assert emitted[0] < 600 * 5 * 19 // 2  # of 600 questions, 5 each, from 19 blocks
    for groups in (3, 1):
        by = rows.withColumn("label", F.col("label") % groups)
        a, b = (sorted((r["query_id"], r["label"], r["id"], r["rank"]) for r in f.collect()) for f in (blocks.msearch(asked, by, 2, by="label", lanes=2), dense.top(asked, by, 2, by="label")))
        assert a == b
