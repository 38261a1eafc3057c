"""Many questions are held by the tasks and documents stream by them: no block is repeated, and no task holds all."""

import random

import numpy as np
import pytest

from passagemill.operators import sparse


def rows(frame):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in frame.collect())


def test_passes_find_what_scoring_everything_finds(spark, monkeypatch):
    for name, value in (("BROADCAST_TERMS", 0), ("PASS_TERMS", 40), ("BLOCK_QUERIES", 3), ("BLOCK_DOCS", 16)):
        monkeypatch.setattr(sparse, name, value)
    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.8)) % 90}"
    docs = spark.createDataFrame([(f"d{i % 90}-{i}", " ".join(word() for _ in range(1 + i % 23))) for i in range(150)] + [(f"e{i}", "w1 w2 w3") for i in range(60)], "id string, text string")
    queries = spark.createDataFrame([(q, " ".join(word() for _ in range(1 + q % 7))) for q in range(30)] + [(40, "w1 w2"), (41, "unheard"), (42, "")], "query_id long, text string")
    made, before = [], sparse._in_blocks
    monkeypatch.setattr(sparse, "_in_blocks", lambda *a: made.append(before(*a)) or made[-1])
    assert rows(sparse.search(queries, docs, 4)) == rows(sparse.top(sparse.scores(queries, docs), 4))
    assert len(made) > 1
    for frame in made:
        assert "Join" not in frame._jdf.queryExecution().toString()  # which gave each pair of blocks a row


@pytest.mark.parametrize("copies", [1, 400])
def test_tables_of_scores_choose_as_adding_in_turn_does(monkeypatch, copies):
    """Small tables, terms by the hundred thousand (places pass 32 bits), weights below zero, and many copies."""
    monkeypatch.setattr(sparse, "TABLE", 3000)
    monkeypatch.setattr(sparse, "OFTEN", 3)
    rng = np.random.default_rng(6)
    n, terms = 8192, 300_000
    pairs = [(t, d) for t in range(12) for d in range(t % 5, n, 2 + 9 * t)] + [(t, int(rng.integers(n))) for t in range(12, terms, 97)]
    pairs += [(t, d) for t in range(terms - 3, terms) for d in range(1000, 1000 + copies)]
    code, docs = (np.array(x) for x in zip(*sorted(set(pairs))))
    starts = np.searchsorted(code, np.arange(terms + 1))
    parts = rng.random(len(docs)) * (code < terms - 3) + 1.0
    codes = [np.unique(np.append(rng.integers(0, 12, 4), [terms - 1 - q % 3, 12 + 97 * q, -1])) for q in range(50)]
    first, codes = np.cumsum([0, *map(len, codes)]), np.concatenate(codes).astype(np.int32)
    weights = rng.random(len(codes)) + 0.1
    weights[first[7] : first[9]] -= 0.6
    places, k = rng.permutation(n), 5
    for bars in (np.full(50, -np.inf), rng.random(50) * 6):
        least = bars.copy()
        got = sparse._best_of(sparse._indexed(starts, docs, parts, n), (first, codes, weights), places, k, least)
        want = []
        for q in range(50):
            at, score = sparse._in_turn((starts, docs, parts), codes[first[q] : first[q + 1]], weights[first[q] : first[q + 1]], n, k, bars[q])
            want += [(q, d, s) for s, _, d in sorted(((s, p, d) for d, s, p in zip(at.tolist(), np.round(score, sparse.DIGITS).tolist(), places[at].tolist())), key=lambda x: (-x[0], x[1]))[:k]]
        assert list(zip(*(x.tolist() for x in got))) == want and len(want) > 80
        assert all(least[q] == max(bars[q], min(s for p, _, s in want if p == q)) for q in range(50) if sum(p == q for p, _, _ in want) == k)
