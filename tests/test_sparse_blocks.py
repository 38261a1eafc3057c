"""BM25 in blocks: the same for few and many queries, and nothing but the best is moved."""

import random

import pytest

from passagemill.operators import sparse
from passagemill.workspace import Workspace


def rows(frame):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in frame.collect())


@pytest.mark.parametrize("broadcast", [0, sparse.BROADCAST_TERMS])
def test_blocks_find_what_scoring_everything_finds(spark, monkeypatch, broadcast):
    monkeypatch.setattr(sparse, "BROADCAST_TERMS", broadcast)
    monkeypatch.setattr(sparse, "BLOCK_DOCS", 50)
    monkeypatch.setattr(sparse, "BLOCK_QUERIES", 7)
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(9000)]
    texts = [" ".join(words[rng.randrange(8900) :][: rng.randrange(1, 40)]) for _ in range(300)]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts + texts[:1] * 90 + ["w1 w1", "", None])], "id string, text string")
    asked = [(q, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for q in range(40)] + [(100, "w1"), (101, texts[0]), (102, "none"), (103, None)]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = sparse.postings(docs), sparse.lengths(docs)
    for k in (1, 6, 1000):
        want = rows(sparse.top(sparse.scores(queries, docs), k))
        assert rows(sparse.search(queries, docs, k)) == want == rows(sparse.search(queries, docs, k, index=index))
    assert sparse.search(queries.limit(0), docs, 3).count() == 0 == sparse.search(queries, docs.limit(0), 3).count()


def test_weights_below_zero_count(spark):
    """In a corpus whose words are all common, scores are negative, and what shares no word is still not found."""
    docs = spark.createDataFrame([(i, "a b c" if i else "z") for i in range(9)], "id long, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, "z a")], "query_id long, text string")
    assert rows(sparse.search(queries, docs, 4)) == rows(sparse.top(sparse.scores(queries, docs), 4))


def test_postings_of_the_corpus_are_not_written(spark, monkeypatch):
    """Few questions leave counts of terms and their own weights on disk."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(200))) for i in range(500)], "id long, text string")
    queries = spark.createDataFrame([(q, f"w{q} w7") for q in range(20)], "query_id long, text string")
    sizes, before = [], Workspace.saved

    def counted(self, df, what="table"):
        sizes.append((what, (made := before(self, df, what)).count()))
        return made

    monkeypatch.setattr(Workspace, "saved", counted)
    assert sparse.search(queries, docs, 5).count() == 100
    assert max(n for _, n in sizes) <= 201  # of 100,000 postings


def test_postings_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b  a", "x"), (2, None, "y"), (3, " \t", "z"), (4, "b", None)], "id long, text string, note string")
    made = sparse.postings(docs, keep=("note",))
    assert sorted(tuple(r) for r in made.collect()) == [(1, "x", "a", 2), (1, "x", "b", 1), (4, None, "b", 1)]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
