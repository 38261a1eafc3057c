import numpy as np
import pytest

from passagemill.llm import ann


def brute(ids, vectors, queries, k):
    x = np.array(vectors, float)
    out = {}
    for q in queries:
        i = ids.index(q)
        scores = ann.cosine(np.broadcast_to(x[i], x.shape), x)
        near = sorted((-s, v) for s, v in zip(scores, ids) if v != q)[:k]
        out[q] = [(v, -s) for s, v in near]
    return out


def test_recall_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    got = {}
    for r in ann.search(table, table.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute([r["vec_id"] for r in rows], [r["embedding"] for r in rows], [r["vec_id"] for r in rows if r["vec_id"] % 50 == 0], 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    found = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / (5 * len(want))
    assert found >= 0.9
    assert all(s == dict(want[q]).get(v, s) for q in want for v, s in got[q])


def test_ties_copies_odd_vectors_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(40, 0, -1)] + [(3, [1.0, 2.0, 0.5])]
    rows += [(50, None), (51, []), (52, [0.0, 0.0, 0.0]), (53, [1.0, nan, 0.0]), (54, [inf, 1.0, 1.0]), (55, [1.0, None, 2.0]), (56, [1.0, 2.0]), (57, [1e300, 2e300, 5e299]), (None, [1.0, 2.0, 0.5])]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, rank string, score string")
    got = ann.search(table, table.where("vec_id in (1, 7, 50, 52, 56, 57)"), k=5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(1, v) for v in (2, 3, 4, 5, 6)] + [(7, v) for v in (1, 2, 3, 4, 5)] + [(57, v) for v in (1, 2, 3, 4, 5)]
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] * 3 and all(abs(r["score"] - 1) < 1e-12 for r in got)


def test_fewer_candidates_than_k_and_empty(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(table, k=5).orderBy("query_id").collect()] == [(1, 2), (2, 1)]
    assert ann.search(table.limit(0), k=5).collect() == []
    x = np.random.default_rng(3).normal(size=(4, 64))  # far from one another: hashing alone misses most
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute(list(range(4)), x, range(4), 5)


def test_several_vectors_of_a_query(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.05, 1.0]), (4, [-1.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(table, table.where("vec_id = 1"), k=2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [3, 2]


def test_cosines_of_huge_and_tiny_vectors():
    a, b = np.array([[1e300, 2e300], [1e-300, 2e-300], [3.0, 4.0]]), np.array([[1.0, 2.0], [2e-310, 4e-310], [5.0, 1.0]])
    assert np.allclose(ann.cosine(a, b)[:2], 1.0) and ann.cosine(a, b)[2] == 19.0 / (5.0 * np.sqrt(26.0))


def test_tuples_of_axes_find_near_vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.05 * rng.normal(size=x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    met = np.zeros(200, bool)
    for t in range(4):
        home, probes = ann.buckets(x, t, 2, 1), ann.buckets(y, t, 2, 8)
        met |= (home == probes).any(axis=1)
    assert met.mean() > 0.97


def recall(spark, path, **options):
    table = spark.read.parquet(path)
    rows = table.orderBy("vec_id").collect()
    got = {}
    for r in ann.search(table, table.where("vec_id % 50 = 0"), **options).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute([r["vec_id"] for r in rows], [r["embedding"] for r in rows], [r["vec_id"] for r in rows if r["vec_id"] % 50 == 0], 5)
    return sum(len(got.get(q, set()) & {v for v, _ in near}) for q, near in want.items()) / (5 * len(want))


def test_recall_on_many_near_random_vectors(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    assert recall(spark, path) >= 0.9
    with pytest.raises(ValueError):
        recall(spark, path, hashes=2)


def clustered(rng, n):
    centres = rng.normal(size=(n // 20, 48))
    return centres[rng.integers(0, len(centres), n)] + 0.12 * rng.normal(size=(n, 48))


def test_choices_keep_their_recall_at_any_size():
    rng = np.random.default_rng(7)
    random_ = rng.normal(size=(4000, 64))
    near = clustered(rng, 4000)
    for x in (random_, near):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        scores = unit[:200] @ unit.T
        scores[np.arange(200), np.arange(200)] = -2
        best = np.argsort(-scores, axis=1)[:, :5]
        pairs = [(np.repeat(x[:64], 5, axis=0), x[best[:64]].reshape(320, -1))]
        others = [(np.repeat(x[64:200], 5, axis=0), x[best[64:]].reshape(680, -1))]
        chosen = [ann.plan(pairs, rows) for rows in (4000, 10**6, 10**9, 10**12)]
        assert all((ann.found_at(others, ann.TABLES, *c) <= c[1]).mean() >= 0.9 for c in chosen)  # on queries that were not in the sample
        assert chosen[0][0] == 1 and (x is random_ or chosen[-1][0] > 1)


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_recall_with_tuples_on_many_rows(spark, monkeypatch, tmp_path, hashes):
    x = clustered(np.random.default_rng(8), 5000)
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").write.parquet(path)
    monkeypatch.setattr(ann, "CHOICES", tuple(c for c in ann.CHOICES if c[0] == hashes))
    assert recall(spark, path) >= 0.9


def test_two_hashes_with_probes_to_match(spark):
    assert recall(spark, "/root/testdata/sf0.1/embeddings.parquet", hashes=2, probes=800) >= 0.9


@pytest.mark.parametrize("dim", [128, 384, 768])
def test_recall_in_many_dimensions(spark, tmp_path, dim):
    x = np.random.default_rng(9).normal(size=(1500, dim)).astype(np.float32)
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").write.parquet(path)
    report = {}
    assert recall(spark, path, report=report) >= 0.9
    assert report["recall"] >= ann.TARGET and (report["hashes"] is None) == (dim > 128)


def test_ids_that_stand_more_than_k_times(spark):
    v = [[1.0, 0.0, 0.01 * i] for i in range(12)]
    rows = [(i, x) for i, x in enumerate(v) for _ in range(2)] + [(1, v[1])] * 9 + [(2, [1.0, 0.001 * j, 0.02]) for j in range(9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = ann.search(table, table.where("vec_id = 0"), k=5).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(i, i) for i in range(1, 6)]
    assert [r["score"] for r in got] == list(ann.cosine(np.array([v[0]] * 5), np.array(v[1:6])))
