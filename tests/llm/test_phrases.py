import random
import re
from collections import Counter

import pytest

from passagemill.llm import hashed_counts as hc
from passagemill.llm import phrases as ph


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, max_words=3, min_count=10, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in range(1, max_words + 1):
                counts.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    good = {p: a for p, a in counts.items() if len(p) > 2 and a >= min_count}
    covered = set()
    for p, longer in good.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                part = (p[0], *p[i : i + k])
                if 100 * longer >= 50 * counts[part]:
                    covered.add(part)
    out = []
    for p, a in good.items():
        if p not in covered:
            lang, w = p[0], p[1:]
            parts = [(counts[(lang, *w[:k])], counts[(lang, *w[k:])]) for k in range(1, len(w))]
            score, _, l, r = min((1_000_000 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(parts))
            out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    ranked, place = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase.decode(), -a, l, r, totals[lang], -score))
    return ranked


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, n int")
    got = ph.collocations(docs, buckets=1 << 14, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows, **options))


def corpus(rng, docs, words, size):
    pool = [f"w{i}" for i in range(words)] + ["Été", "naïve", "x-y", "ЖУК"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    ends = [" "] * 12 + [". ", ", ", "\n", "\t", "  ", "? ", ";"]
    return ["".join(rng.choices(pool, weights)[0] + rng.choice(ends) for _ in range(rng.randrange(size))) for _ in range(docs)]


def test_languages_ties_and_repeats(spark):
    rng = random.Random(1)
    texts = corpus(rng, 150, 60, 80)
    rows = [(t, rng.choice(["en", "en", "en", "de", None, "und"])) for t in texts] + [("New York, new york city! NEW YORK", "en")] * 7
    check(spark, rows)
    check(spark, rows, min_count=3, top=15)


def test_longer_phrases_and_pairs_only(spark):
    rows = [(t, "en") for t in corpus(random.Random(2), 60, 12, 60)]
    check(spark, rows, max_words=5, min_count=4)
    check(spark, rows, max_words=2, min_count=4)


def test_odd_texts(spark):
    long = "very long text with words, " * 30_000
    rows = [(None, "en"), ("", "en"), (" \t\n", "fr"), ("...!?", None), ("one", "en"), (long, "en"), ("a\x0bb " * 12, "fr"), ("a\xa0b c " * 12, "fr"), ("r " * 500, "de"), ("q", "it")]
    check(spark, rows)
    check(spark, [("alone", "en")])
    docs = spark.createDataFrame([], "text string, lang string")
    assert ph.collocations(docs).collect() == []


def test_results_do_not_hang_on_slices_tasks_or_buckets(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(t, rng.choice(["en", None])) for t in corpus(rng, 80, 40, 60)]
    monkeypatch.setattr(ph.co, "SLICE_BYTES", 300)
    monkeypatch.setattr(ph, "HELD_ROWS", 50)
    monkeypatch.setattr(ph, "HEAVY", 5)
    monkeypatch.setattr(ph, "SHARES", 3)
    check(spark, rows, min_count=4)


def test_full_buckets_only_cost_work(spark):
    rows = [(t, "en") for t in corpus(random.Random(4), 60, 30, 60)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    for buckets in (8, 64, 1 << 13):
        got = ph.collocations(docs, min_count=4, buckets=buckets)
        assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows, min_count=4))


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(5)
    rows = [(9_999_999_999_999_999,) * 3, (1, 9_999_999_999_999_999, 9_999_999_999_999_999)]
    for _ in range(300):
        left, right = (rng.randrange(1, 10 ** rng.randrange(2, 16)) for _ in range(2))
        rows.append((rng.randrange(1, min(left, right) + 1), left, right))
    docs = spark.createDataFrame(rows, "a long, l long, r long").selectExpr("*")
    got = docs.select("a", "l", "r", ph.score(docs.a, docs.l, docs.r).alias("s")).collect()
    assert all(r["s"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in got)


def test_tallies_stop_at_their_limit_and_add_up(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 2**63, 4000).astype(np.uint64) for _ in range(3)]
    tallies = []
    for p in parts:
        tallies.append(hc.Tally(5, 1 << 9))
        tallies[-1].add(p)
    rows = [tuple(r.values()) for t in tallies for r in t.rows().to_pylist()]
    got = hc.table(spark.createDataFrame(rows, hc.ROWS), 5, 1 << 9)
    want = np.minimum(np.bincount(hc.bucket_of(np.concatenate(parts), 1 << 9), minlength=1 << 9), 5)
    assert (got == want).all()
    assert hc.marked(np.packbits(want >= 5), parts[0], 1 << 9).tolist() == (want[hc.bucket_of(parts[0], 1 << 9)] >= 5).tolist()


def test_a_least_count_that_the_tables_cannot_hold(spark):
    with pytest.raises(ValueError):
        ph.collocations(spark.createDataFrame([], "text string, lang string"), min_count=70_000)
