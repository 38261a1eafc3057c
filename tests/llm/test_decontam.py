import hashlib
import re

from passagemill.llm import decontam


def words(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w = words(text)
    hit, names = set(), set()
    for item, said in items:
        b = words(said)
        n = min(13, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                names.add(None if item is None else str(item))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def rows_of(marked):
    return {r["doc_id"]: tuple(r[1:6]) for r in marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}


def test_fixtures_against_brute_force(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [tuple(r) for r in bench.collect()]
    want = {r["doc_id"]: brute(r["text"], items) for r in docs.collect()}
    assert any(v[4] for v in want.values())
    assert rows_of(decontam.mark(docs, bench)) == want
    assert rows_of(decontam.mark(docs, bench, max_windows=1)) == want  # an item to a group


CASES = [(1, None), (2, ""), (3, "!!! ..."), (4, "Short Item! and more"), (5, "x " * 30 + "ÀB-c d" + " y" * 200), (6, "à b c d"), (7, "a" * 100_000), (8, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (9, " ".join(["r"] * 40)), (10, "short"), (11, "item short item")]
ITEMS = [(1, None), (2, "..."), (3, "short item"), (4, "Àb c D"), (10, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (11, " ".join(["r"] * 20)), (9, "short item"), (None, "more"), (None, "Item!")]


def test_odd_texts_short_items_and_spans(spark):
    docs = spark.createDataFrame([(i, t, "n") for i, t in CASES], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    marked = decontam.mark(docs.drop("n_words"), bench)
    want = {i: brute(t, ITEMS) for i, t in CASES}
    assert rows_of(marked) == want
    assert rows_of(decontam.mark(docs.drop("n_words"), bench, max_windows=1)) == want
    texts = dict(CASES)
    cut = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["hit_spans"]] for r in marked.collect()}
    assert cut[4] == ["Short Item", "more"] and cut[5] == ["ÀB-c d"]
    kept = decontam.remove(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i, t in CASES if not brute(t, ITEMS)[4]]
    rest = {r["doc_id"]: r["text"] for r in decontam.remove(docs, bench, how="spans").collect()}
    assert rest[4] == "! and " and rest[10] == "short" and rest[1] is None and rest[5] == texts[5]


def test_kept_columns_named_like_results(spark):
    docs = spark.createDataFrame([(4, CASES[3][1], "n", 1.5)], "doc_id long, text string, n_words string, `hit spans.x` double")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    marked = decontam.mark(docs, bench, keep=["n_words", "hit spans.x"])
    row = marked.first()
    assert marked.columns[:4] == ["doc_id", "text", "n_words_input", "hit spans.x"] and row["n_words_input"] == "n" and row["n_words"] == 4


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert rows_of(decontam.mark(docs, bench)) == {1: brute("a b", [])}
    assert decontam.mark(docs.limit(0), bench).collect() == []
