import random
import re

import numpy as np

from passagemill.llm import near_dup as nd


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, n int, h1 int, kept int")
    assert {r["doc_id"]: tuple(r[1:]) for r in nd.near_duplicates(docs).collect()} == brute(rows)


def mutated(rng, base, changes):
    w = base.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_mutated_clusters_copies_and_chains(spark):
    rng = random.Random(3)
    texts = []
    for size in (150, 60, 400):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(size))
        texts += [mutated(rng, base, rng.randrange(0, size // 12)) for _ in range(120)] + [base] * 40
    chain = " ".join(f"c{i}" for i in range(200))
    for _ in range(12):
        texts.append(chain)
        chain = mutated(rng, chain, 4)
    rng.shuffle(texts)
    check(spark, [(7 * i + 3, t) for i, t in enumerate(texts)])


def test_odd_texts(spark):
    long = " ".join(f"z{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "one two three four five"), (8, "one\x0btwo\x0cthree four"), (9, long), (10, long + " end"), (11, "é È"), (12, "É È"), (13, "a\xa0b"), (14, "a b"), (15, "r " * 500), (16, "r r r r r")]
    check(spark, rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (3, "z")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = sorted(((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in nd.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(0, 1, False), (0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)], key=str)
    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.where("doc_id is not null").collect()) == [1, 3]
    assert nd.near_duplicates(docs.limit(0)).collect() == []


def test_fixtures(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r["doc_id"]: tuple(r[1:]) for r in nd.near_duplicates(docs).collect()} == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_estimates_merging_and_locality():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [pool[:2000], pool[500:2500], pool[:3000], pool[2000:3000]]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    rows = nd.sketches(np.concatenate([np.sort(s) for s in sets]), offsets)
    assert (np.maximum(rows[0], rows[3]) == rows[2]).all()
    big = nd.sketches(np.concatenate([sets[0], sets[1]]), np.array([0, 2000, 4000]), 4096)
    guess = nd.likely_jaccard(big[:1], big[1:], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(guess - 1500 / 2500) < 0.03
    assert nd.sketches(np.zeros(0, np.uint64), np.array([0, 0])).sum() == 0


def test_rows_without_ids_and_shared_ids_are_decided_by_their_texts(spark):
    rng = random.Random(5)
    base = [" ".join(f"v{rng.randrange(5000)}" for _ in range(120)) for _ in range(8)]
    near = [mutated(rng, t, 2) for t in base]
    rows = [(None, base[0]), (None, base[0]), (None, near[0]), (None, base[1]), (None, base[2]), (None, near[2])]  # one each of 0 and 1, none of 2
    rows += [(2, base[2]), (7, base[3]), (7, base[4]), (7, base[4]), (5, near[4]), (8, base[5]), (8, near[5]), (9, base[6]), (None, ""), (None, None), (10, ""), (10, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    said = nd.near_duplicates(docs)
    assert said.columns == ["doc_id", "n_shingles", "component_id", "kept"] and said.count() == len(rows)
    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns
    place = {t: k for k, t in [*enumerate(base), *enumerate(near)]}
    got = sorted(((r["doc_id"] or 0, place.get(r["text"], -1)) for r in kept.collect()))
    assert got == sorted([(0, 0), (0, 1), (2, 2), (7, 3), (5, 4), (8, 5), (9, 6), (0, -1), (0, -1), (10, -1)])


def test_different_texts_of_one_id_keep_their_links(spark):
    rng = random.Random(6)
    a, b = (" ".join(f"u{rng.randrange(9000)}" for _ in range(60)) for _ in range(2))
    rows = [(1, b), (1, a), (2, a + " word"), (3, b + " word"), (4, "alone")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}


def test_full_buckets_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_ROWS", 4)
    rng = random.Random(7)
    common = " ".join(f"s{i}" for i in range(100))  # alike, but not enough to be linked, except for neighbours
    texts = [common + " " + " ".join(f"t{k}x{rng.randrange(10**6)}" for _ in range(34)) for k in range(25)]
    texts += [mutated(rng, t, 1) for t in texts[:20]]
    check(spark, list(enumerate(texts)))


def test_a_third_without_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    part = docs.selectExpr("if(doc_id % 3 = 0, null, doc_id) as doc_id", "text", "source")
    want = sum(k for _, _, k in brute([(r["doc_id"], r["text"]) for r in docs.where("text is not null").collect()]).values())
    assert nd.deduplicated(part.where("text is not null")).count() == want
