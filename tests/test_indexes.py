"""The indexes of dense and sparse search, and searches in blocks, against scans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.config import StoreConfig
from passagemill.operators import blocks, cells, dense, postings, sparse
from passagemill.operators.store import PassageStore
from passagemill.streaming import ingest

ROWS = "id string, vector array<float>, label int"


def rows_of(spark, x, start=0):
    return spark.createDataFrame([(f"k{i + start:05d}", v, i % 3) for i, v in enumerate(x.tolist())], ROWS)


def asked_of(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "query_id long, vector array<float>")


def plain(found):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 5)) for r in found.collect())


def clustered(rng, n, dim, groups, spread=0.02):
    middle = rng.normal(size=(groups, dim))
    return (middle[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


ODD = [("zero", [0.0, 0.0, 0.0]), ("none", None), ("empty", []), ("hole", [1.0, None, 0.0]), ("nan", [1.0, math.nan, 0.0]), ("inf", [1.0, math.inf, 0.0]), ("short", [1.0, 0.0]), ("long", [1.0, 0.0, 0.0, 0.0]), ("a", [1.0, 0.0, 0.0]), ("b", [1.0, 1.0, 0.0]), ("c", [-1.0, 0.0, 0.0]), ("huge", [3e38, 0.0, 3e38]), ("tiny", [1e-38, 0.0, 0.0])]


@pytest.mark.parametrize("kind", ["cosine", "dot", "l2"])
def test_vectors_that_take_no_part_hide_no_others(spark, kind):
    rows = spark.createDataFrame([(*r, 0) for r in ODD], ROWS).coalesce(1)
    asked = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(ODD)], "query_id long, vector array<float>")
    fine = [k for k, (n, v) in enumerate(ODD) if v and all(x is not None and math.isfinite(x) for x in v) and (kind != "cosine" or any(v))]
    want = {(q, ODD[k][0]) for q in fine for k in fine if len(ODD[q][1]) == len(ODD[k][1])}
    for found in (dense.top(asked, rows, 20, distance=kind), blocks.msearch(asked, rows, 20, kind=kind)):
        assert {(r["query_id"], r["id"]) for r in found.collect()} == want
    for k in (1, 2, 3):  # the best stay the best beside a zero vector
        assert plain(dense.top(asked, rows, k, distance=kind)) == [r for r in plain(dense.top(asked, rows, 20, distance=kind)) if r[1] <= k]


def test_many_questions_meet_passages_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(150, 12)), np.ones((40, 12))]).astype(np.float32)
    rows, asked = rows_of(spark, x).repartition(3), asked_of(spark, x[::5])
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    for kind in ("cosine", "l2"):
        want = plain(dense.top(asked, rows, 7, distance=kind))
        assert plain(blocks.msearch(asked, rows, 7, kind=kind, lanes=5)) == want
    by = sorted(map(tuple, dense.top(asked, rows, 2, by="label").collect()))
    monkeypatch.setattr(dense, "BLOCK_COMPONENTS", 100)
    assert plain(dense.top(asked, rows, 7, distance="l2")) == want
    assert sorted(map(tuple, dense.top(asked, rows, 2, by="label").collect())) == by
    assert dense.top(asked, rows.limit(0), 2).collect() == [] and blocks.msearch(asked.limit(0), rows, 2).collect() == []


@pytest.mark.parametrize("kind", ["cosine", "dot", "l2"])
def test_cells_give_what_a_scan_gives(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(cells, "LANE_ROWS", 40)
    monkeypatch.setattr(cells, "VISITS", 30)
    rng = np.random.default_rng(2)
    x = np.concatenate([clustered(rng, 500, 16, 12), rng.normal(size=(100, 16)), np.tile(rng.normal(size=(1, 16)), (200, 1)), np.zeros((3, 16))]).astype(np.float32)
    rows, asked = rows_of(spark, x), asked_of(spark, np.concatenate([x[::40], rng.normal(size=(5, 16))]).astype(np.float32))
    cells.build(rows, str(tmp_path / "i"), dim=16, kind=kind, cell_rows=40)
    index = cells.Cells(spark, str(tmp_path / "i"), kind)
    assert len(index.known.cells) > 5
    for k in (1, 10):
        assert plain(index.search(asked, k)) == plain(dense.top(asked, rows, k, distance=kind))
    gone = rows.where("label = 1").select("id")
    some = cells.Cells(spark, str(tmp_path / "i"), kind, gone)
    assert plain(some.search(asked, 4)) == plain(dense.top(asked, rows.where("label != 1"), 4, distance=kind))


def test_clustered_vectors_leave_most_cells_unread(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = clustered(rng, 2000, 24, 20)
    rows, asked = rows_of(spark, x), asked_of(spark, x[:2])
    cells.build(rows, str(tmp_path / "i"), dim=24, cell_rows=60)
    index = cells.Cells(spark, str(tmp_path / "i"))
    assert plain(index.search(asked, 5)) == plain(dense.top(asked, rows, 5))
    assert len(index.read) <= len(index.known.cells) / 2
    plan = index._rows(sorted(index.read))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_odd_rows_and_empty_indexes(spark, tmp_path):
    rows = spark.createDataFrame([(*r, 0) for r in ODD], ROWS)
    asked = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(ODD)], "query_id long, vector array<float>").where("size(vector) = 3")
    cells.build(rows, str(tmp_path / "i"), dim=3)
    assert plain(cells.Cells(spark, str(tmp_path / "i")).search(asked, 20)) == plain(dense.top(asked, rows, 20))
    cells.build(rows.limit(0), str(tmp_path / "e"), dim=3)
    assert cells.Cells(spark, str(tmp_path / "e")).search(asked, 3).collect() == []


def test_a_store_searches_its_parts(spark, tmp_path):
    rng = np.random.default_rng(4)
    schema = "id string, vector array<float>, label int, text string, ingest_seq long"
    made = lambda ids: spark.createDataFrame([(f"k{i:03d}", rng.normal(size=8).tolist(), 0, f"word {i}", n) for n, i in enumerate(ids)], schema)
    s = PassageStore(spark, StoreConfig(path=str(tmp_path / "s"), dim=8, merge_share=100.0))
    asked = asked_of(spark, rng.normal(size=(6, 8)).astype(np.float32))
    assert s.nearest(asked, 3) is None
    assert s.upsert(made([*range(60), 5, 5])) == 62
    s.upsert(made(range(50, 80)))
    s.delete_ids(spark.createDataFrame([("k010",), ("k070",)], "id string"))
    assert plain(s.nearest(asked, 9)) == plain(dense.top(asked, s.rows(), 9))


def test_sequences_of_ingest_never_repeat(spark):
    docs = spark.range(300).selectExpr("concat('a passage that is long enough, number ', id) as text", "'technical' as doc_type", "'s' as source").repartition(300)
    rows = [ingest.passages(docs, seq=n) for n in (3, 4)]
    seqs = [[tuple(r[0]) for r in x.select("ingest_seq").collect()] for x in rows]
    assert len(set(seqs[0])) == 300 and max(seqs[0]) < min(seqs[1])


def words(rng, n, pool=300):
    return " ".join(f"w{int(pool * rng.random() ** 3)}" for _ in range(n))


def test_posting_blocks_give_what_all_postings_give(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE_DOCS", 8)
    rng = np.random.default_rng(5)
    docs = [(i, words(rng, int(rng.integers(1, 80)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "rare rare"), (1003, "rare"), (1004, "W1 w1")]
    docs = spark.createDataFrame(docs, "id long, text string")
    asked = spark.createDataFrame([(i, words(rng, 6)) for i in range(20)] + [(50, "rare"), (51, "unheard"), (52, None), (53, "w0 w0 w0 w1 rare unheard")], "query_id long, text string")
    path = str(tmp_path / "p")
    postings.build(docs, path)
    index = postings.Postings(spark, path)
    for k in (1, 7, 600):
        assert plain(index.search(asked, k)) == plain(sparse.search(asked, docs, k))
    plan = index.blocks([3], "most")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "postings" not in plan.split("ReadSchema")[1]


def test_posting_blocks_of_nothing(spark, tmp_path):
    asked = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    for n, docs in enumerate([[], [(1, None), (2, "")]]):
        postings.build(spark.createDataFrame(docs, "id long, text string"), str(tmp_path / f"p{n}"))
        assert postings.Postings(spark, str(tmp_path / f"p{n}")).search(asked, 3).collect() == []


def test_a_store_follows_the_state_of_its_documents(spark, tmp_path):
    s = PassageStore(spark, StoreConfig(path=str(tmp_path / "s"), dim=4, merge_share=100.0))
    text = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    put = lambda rows: spark.createDataFrame(rows, "source string, page_number int, text string, doc_type string")
    one = [("a", 1, text("a", 200), "x"), ("a", 2, text("b", 90), "x"), ("b", 1, text("c", 50), "x"), ("c", 1, text("d", 400), "x"), ("d", 1, "short", "x"), (None, 1, text("e", 30), "x")]
    said = lambda f: {(r["source"], r["change"]) for r in f.collect()}
    held = lambda: {(r["source"], r["page_number"], r["text"]) for r in s.rows().collect()}
    fresh = lambda rows: {(r["source"], r["page_number"], r["text"]) for r in ingest.passages(put(rows).fillna({"source": "unknown"})).collect()}
    assert said(ingest.sync(put(one), s)) == {("a", "added"), ("b", "added"), ("c", "added"), ("unknown", "added")} and held() == fresh(one)
    parts = len(s._parts("corpus"))
    assert said(ingest.sync(put(one[::-1]).union(put(one)), s, seq=1)) == set() and len(s._parts("corpus")) == parts  # nothing new: no part
    two = [one[0], ("a", 2, text("changed", 90), "x"), ("b", 1, one[2][2] + " \n", "x"), ("e", 1, text("d", 400), "x"), one[5]]
    assert said(ingest.sync(put(two), s, seq=2)) == {("a", "changed"), ("c", "removed"), ("e", "added")} and held() == fresh(two)
    assert said(ingest.sync(put([("z", 1, text("z", 20), "x")]), s, corpus_id="other", seq=3)) == {("z", "added")} and held() == fresh(two) | fresh([("z", 1, text("z", 20), "x")])
    ingest.sync(put([]), s, seq=4)
    assert held() == fresh([("z", 1, text("z", 20), "x")])


def test_few_distances_to_centres_are_held_at_once():
    import tracemalloc

    rng = np.random.default_rng(5)
    u, c = rng.normal(size=(5000, 16)), rng.normal(size=(2048, 16))
    want = np.array([((x - c) ** 2).sum(1).argmin() for x in u[:200]])
    tracemalloc.start()
    got = cells.nearest_centres(u, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[:200] == want).all() and len(got) == 5000
    assert peak < 40 << 20  # all at once: 160 MB


def test_known_scores_may_be_forgotten(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(90)], "id long, vector array<double>")
    asked = rows.select(F.col("id").alias("query_id"), "vector")
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    made = []
    for most in (blocks.KNOWN_BYTES, 1):
        monkeypatch.setattr(blocks, "KNOWN_BYTES", most)
        made.append(sorted(map(tuple, blocks.msearch(asked, rows, 3).collect())))
    assert made[0] == made[1] and len(made[0]) == 270
