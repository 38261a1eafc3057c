import random
import re

import numpy as np
import pytest

from passagemill.llm import ngram_join as nj


def shingles(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size=4, similarity=(85, 100)):
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (_, a) in enumerate(sets):
        for m, (_, b) in enumerate(sets[k + 1 :], k + 1):
            if a and b and similarity[1] * len(a & b) >= similarity[0] * len(a | b):
                root[top(m)] = top(k)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(s), least.get(top(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, n int, id int, key int")
    got = nj.similar(docs, buckets=1 << 14, **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, **options)


def mutated(rng, base, changes):
    w = base.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def clusters(rng):
    texts = []
    for size in (150, 60, 400):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(size))
        texts += [mutated(rng, base, rng.randrange(0, max(2, size // 30))) for _ in range(80)] + [base] * 30
    chain = " ".join(f"c{i}" for i in range(200))
    for _ in range(12):
        texts.append(chain)
        chain = mutated(rng, chain, 2)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    rng.shuffle(texts)
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


def test_mutated_clusters_copies_chains_and_shared_passages(spark):
    check(spark, clusters(random.Random(3)))


@pytest.mark.parametrize("similarity", [(6, 10), (95, 100), (1, 1)])
def test_other_settings(spark, similarity):
    check(spark, clusters(random.Random(4))[:200], size=3, similarity=similarity)


def test_odd_texts(spark):
    long = " ".join(f"z{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two three four"), (8, "one\x0btwo\x0cthree four"), (9, long), (10, long + " end"), (11, "é È"), (12, "É È"), (13, "a\xa0b"), (14, "a b"), (15, "r " * 500), (16, "r r r r")]
    check(spark, rows)


def test_repeated_rows_null_ids_shared_ids_and_empty_tables(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(1, a), (1, a), (2, a + " x"), (None, a), (None, "q"), (None, b), (None, b + " y"), (3, "z"), (4, b), (4, a), (None, None), (5, "")]
    check(spark, rows)
    assert nj.similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("few", [1, 6, 1000])
def test_full_buckets_in_several_blocks_and_hot_classes(spark, monkeypatch, few):
    monkeypatch.setattr(nj, "BLOCK_ROWS", 4)
    monkeypatch.setattr(nj, "SPREAD_ROWS", 3)
    monkeypatch.setattr(nj, "FEW", few)
    rng = random.Random(7)
    common = " ".join(f"s{i}" for i in range(100))  # alike, but not enough to be linked, except for neighbours
    texts = [common + " " + " ".join(f"t{k}x{rng.randrange(10**6)}" for _ in range(20)) for k in range(40)]
    texts += [mutated(rng, t, 1) for t in texts[:30]]
    check(spark, list(enumerate(texts)))


def test_any_counts_give_the_same_result(spark):
    rows = clusters(random.Random(8))[:200]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for buckets in (8, 1 << 13):
        assert sorted((tuple(r) for r in nj.similar(docs, buckets=buckets).collect()), key=str) == brute(rows)


def test_filters_lose_no_link_and_spare_work():
    rng = np.random.default_rng(9)
    passed = tried = 0
    for _ in range(4000):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) < rng.choice([0.5, 0.9, 0.97, 1])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)]))
        if not len(b):
            continue
        for similarity in ((85, 100), (6, 10), (1, 1)):
            said = nj.may_link(nj.ends(a, similarity), nj.ends(b, similarity), len(a), len(b), similarity)
            true = nj.linked(a, b, similarity)
            assert said or not true
            passed += said and not true
            tried += not true
    assert passed < tried / 5


def test_fixtures(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted((tuple(r) for r in nj.similar(docs).collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_tables_go_as_soon_as_nothing_reads_them(spark, monkeypatch):
    standing = {}

    class Watched(nj.Workspace):
        def saved(self, df, what="table"):
            standing.setdefault(what, [p.rsplit("/", 1)[1].split("-")[1] for p in self.paths])
            return super().saved(df, what)

    monkeypatch.setattr(nj, "Workspace", Watched)
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(words[: 60 - k % 3] + [f"x{k % 3}"])) for k in range(12)]
    got = nj.similar(spark.createDataFrame(rows, "doc_id long, text string"), buckets=1 << 12)
    assert {r["component_id"] for r in got.collect()} == {0}
    assert "signatures" not in standing["prefixes"]
    assert not {"prefixes", "shared", "full"} & set(standing["sized"])
    assert not {"met", "sized", "buckets", "pairs", "close", "sets"} & set(standing["components"])
