import math
from collections import Counter

from jobs import question_report as job


def tables(spark, path, turns, docs):
    spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, rank int").write.parquet(f"{path}/turns")
    spark.createDataFrame([(*d, 0.0) for d in docs], "doc_id long, text string, source string, score double").write.parquet(f"{path}/docs")
    return f"{path}/turns", f"{path}/docs", f"{path}/out"


def brute(turns, docs, k, weak_below):
    """BM25 in plain Python."""
    docs = {d: (t or "", s) for d, t, s in docs if d is not None}
    tf = {d: Counter(t.split()) for d, (t, _) in docs.items()}
    n, mean = len(docs), sum(sum(c.values()) for c in tf.values()) / max(len(docs), 1)
    df = Counter(t for c in tf.values() for t in c)
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(raw.values()) / max(len(raw), 1)
    asked, convs = Counter(), {}
    for conv, _, role, text in turns:
        said = " ".join((text or "").split())
        if (role or "").lower() == "user" and said:
            asked[said] += 1
            convs.setdefault(said, set()).update({conv} - {None})
    out = []
    for q, times in asked.items():
        scores = []
        for d, c in tf.items():
            hit = [t for t in q.split() if t in c]
            if hit:
                scores.append((-round(sum((raw[t] if raw[t] >= 0 else floor) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in hit), 6), d))
        best = sorted(scores)[:k]
        words = len(q.split())
        cover = "none" if not best else "weak" if -best[0][0] < weak_below * words else "answered"
        out += [(q, words, times, len(convs[q]), r, d, docs[d][1], -s, cover) for r, (s, d) in enumerate(best, 1)] or [(q, words, times, len(convs[q]), None, None, None, None, cover)]
    return sorted(out, key=str)


def got(spark, out):
    rows = job.read(spark, out).collect()
    assert all(len(r["question_id"]) == 64 for r in rows)
    return sorted((tuple(r)[1:] for r in rows), key=str)


def test_counts_ties_gaps_and_reruns(spark, tmp_path):
    docs = [(i, " ".join(f"w{(i * j) % 23}" for j in range(1, 5 + i % 7)), f"s{i % 3}") for i in range(60)]
    docs += [(100, None, "s"), (101, "", None), (102, "rare words here", "s"), (103, "rare words here", "s"), (None, "rare words here", "s")]
    turns = [(c, 0, "user", "w1 w2  w3") for c in range(9)] + [(1, 2, "USER", "w1 w2\tw3"), (None, 0, "user", " w1 w2 w3 ")]
    turns += [(5, 1, "assistant", "w4"), (5, 2, None, "w5"), (6, 0, "user", None), (6, 1, "user", " \n"), (7, 0, "user", "unheard of"), (7, 1, "user", "rare words"), (8, 0, "user", "w1 " + "x" * 5000), (8, 1, "user", "w7 w7 w8")]
    a, b, out = tables(spark, tmp_path, turns, docs)
    job.run(spark, a, b, out)
    want = brute(turns, docs, 5, 1.0)
    assert {w[-1] for w in want} == {"none", "weak", "answered"}
    assert got(spark, out) == want
    job.run(spark, a, b, out)
    assert got(spark, out) == want
    job.run(spark, a, b, out, {"k": 2, "weak_below": 0.0})
    assert got(spark, out) == brute(turns, docs, 2, 0.0), "no partition of an earlier report stays"


def test_repeated_documents_count_once(spark, tmp_path):
    a, b, out = tables(spark, tmp_path, [(1, 0, "user", "apple")], [(1, "apple pie", "s")] * 3 + [(2, "apple", "s"), (3, "pear", "s"), (4, "fig", "s"), (5, "nut", "s")])
    job.run(spark, a, b, out)
    assert sorted((r[4], r[5]) for r in got(spark, out)) == [(1, 2), (2, 1)]


def test_empty_tables(spark, tmp_path):
    for k, (turns, docs) in enumerate([([], []), ([], [(1, "a", "s")]), ([(1, 0, "user", "a")], [])]):
        a, b, out = tables(spark, f"{tmp_path}/{k}", turns, docs)
        job.run(spark, a, b, out)
        assert got(spark, out) == brute(turns, docs, 5, 1.0)
