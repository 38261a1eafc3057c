import importlib

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "!! 12", "en", "s", 5), (10_003, "Write to me.too@mail.example.org please", "en", "s", 40)], docs.schema)
    at, sizes = docs.unionByName(extra), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf).cache()
        assert at.columns == docs.columns
        sizes.append(at.count())
    assert sizes[0] == 201 and sizes[0] > sizes[1] > sizes[2] == sizes[3]
    rows = {r["doc_id"]: r["text"] for r in at.collect()}
    assert rows[10_003] == "Write to [EMAIL] please" and not any("@mail" in t for t in rows.values())
    last = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert last.count() == sizes[-1] and "piece_ids" in last.columns


def test_run_and_registration(spark, sf):
    entry = importlib.import_module("__spark_entry__")
    found = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in found if k.startswith("op")}
    assert found["pipeline"](spark, sf).count() > 100


def test_last_stage_decodes(spark, sf):
    docs = spark.createDataFrame([(1, " a  b\n", "en", "s"), (2, "", "en", "s"), (3, None, "en", "s"), (4, "naïve \u2581 x", "en", "s")], "doc_id long, text string, lang string, source string")
    name, stage = corpus_pipeline.STAGES[-1]
    got = {r["doc_id"]: (r["piece_ids"], r["round_trip"]) for r in stage(spark, docs, sf).collect()}
    assert [got[k][1] for k in (1, 2, 3, 4)] == [True, True, None, True] and got[3][0] is None and len(got[1][0]) > 0


def test_empty_tables_and_clashing_columns_through_all_stages(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, piece_ids string, kept string, id string, spans string, h string, class string, b1 string, base string, c0 string"
    extra = ("w", "p", "k", "i", "s", "h", "c", "b", "a", "0")
    rows = [(i, t, "en" if i % 3 else None, "s", 9, *extra) for i, t in enumerate(["The house is on the hill and the road is long", "The house is on the hill and the road is long", None, "", "Das Haus steht auf dem Berg, write to a.b@c.org", "x" * 50_000])]
    for some in (rows, []):
        at = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, sf).cache()
            assert ", ".join(f"{n} {t.replace('bigint', 'long')}" for n, t in at.dtypes) == schema
        kept = {r["doc_id"]: r["text"] for r in at.collect()}
        assert kept == ({0: rows[0][1], 4: "Das Haus steht auf dem Berg, write to [EMAIL]", 5: rows[5][1]} if some else {})
        assert all(tuple(r)[5:] == extra for r in at.collect())
        assert corpus_pipeline.STAGES[-1][1](spark, at, sf).count() == len(kept)


def test_whole_run_against_brute_force(spark, tmp_path):
    """All stages' decisions on a small corpus, by plain Python over whole texts."""
    import random

    from tests.llm import test_decontam, test_language, test_near_dup, test_pii, test_sentencepiece

    rng = random.Random(12)
    vocabulary = {"en": "the house is on a hill and road was long we see many trees", "de": "das haus steht auf dem berg und die strasse ist lang wir sehen"}
    said = lambda lang, n: " ".join(rng.choice(vocabulary[lang].split()) + str(rng.randrange(60)) * (rng.random() < 0.5) for _ in range(n))
    bench = [(1, said("en", 30)), (2, said("de", 9))]
    texts = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        text = said(lang, rng.randrange(8, 60))
        text += rng.choice(["", "", f" me{i}@x.org", " +49 30 1234567", " 10.0.0.7 4111 1111 1111 1111", " " + bench[0][1], " " + bench[1][1] + " and"])
        texts.append((lang, text))
        if rng.random() < 0.4:
            texts.append((lang, rng.choice([text, text + " end", text.upper()])))
    texts += [(None, None), ("en", ""), ("en", "12 !! 7"), ("de", " \n")]
    rows = [(3 * i + 1, t, lang, "s", len(t or "")) for i, (lang, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: (r["lang"], r["source"], list(r["piece_ids"]), r["round_trip"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    at = [r for r in rows if test_language.letters(r[1] or "")]  # labels teach both languages, and every word has letters
    groups = test_near_dup.brute([(r[0], r[1]) for r in at])
    at = [r for r in at if groups[r[0]][2]]
    at = [r for r in at if not test_decontam.brute(r[1], bench)[4]]
    found = test_pii.graph_scores([r[1] for r in at])
    want = {}
    for r, more in zip(at, found):
        text, out, end = r[1], [], 0
        for a, minus, kind in sorted((a, -b, k) for k, a, b in {*test_pii.brute(text), *more}):
            if a >= end:
                out += [text[end:a], f"[{kind.upper()}]"]
            end = max(end, -minus)
        ids = test_sentencepiece.brute("".join(out) + text[end:])
        want[r[0]] = (r[2], r[3], ids, True)
    assert got == want and 10 < len(want) < len(rows) - 15
