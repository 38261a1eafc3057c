import math
from collections import Counter

from pyspark.sql import functions as F

from passagemill.llm import language as lg


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lg.train(docs.where(~lg.held_out(F.col("doc_id"))))
    assert model.languages == ["de", "en", "es", "fr"]
    out = lg.identify(docs, model, keep=["doc_id", "lang"]).where(lg.held_out(F.col("doc_id")))
    n, right, odd = out.select(F.count(F.lit(1)), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum((~F.col("score").between(0, 1)).cast("int"))).first()
    assert n > 200 and right / n > 0.97 and odd == 0


def test_backs_off_from_words_to_shorter_grams():
    model = lg.fit([("a", "house", 9), ("a", "mouse", 3), ("b", "haus", 9), ("b", "maus", 3)], ["a", "b"])
    said = model.score(["house", "hous", "haust", "zzz"])
    assert list(said[:3].argmax(axis=1)) == [0, 0, 1] and not said[3].any()


def test_odd_texts_and_no_labels(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", "en"), (4, "the house", "en"), (5, "das haus", "de"), (6, "x" * 200_000, None), (7, "日本", None), (8, "the house", "en")]
    docs = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, lang string, score string")
    out = {r["doc_id"]: (r["lang_pred"], r[-1]) for r in lg.identify(docs, lg.train(docs), keep=["doc_id", "lang"]).collect()}
    assert [out[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert out[4][0] == out[8][0] == "en" and out[5][0] == "de" and out[7] == ("de", 0.5)
    bare = lg.identify(docs, lg.train(docs.where("lang = 'none'")))
    assert bare.columns == ["doc_id", "text", "lang", "score_input", "lang_pred", "score"] and {r[4] for r in bare.collect()} == {"und"}
    assert lg.identify(docs.limit(0), lg.train(docs)).collect() == []


def test_the_label_is_no_input(spark):
    docs = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the house is", "en"), ("das haus ist", "de")] * 3)], "doc_id long, text string, lang string")
    model = lg.train(docs)
    turned = docs.withColumn("lang", F.lit("de")).withColumn("doc_id", -F.col("doc_id"))
    a, b = (sorted((r["text"], r["lang_pred"], r["score"]) for r in lg.identify(d, model).collect()) for d in (docs, turned))
    assert a == b


def letters(text):
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def brute(labelled, text):
    """Language and score by the definitions: known words by their log frequency, others by the longest n-grams known."""
    languages = sorted({lang for lang, _ in labelled})
    words = {lang: Counter() for lang in languages}
    for lang, said in labelled:
        words[lang].update(letters(said))
    cells = lambda w, n: [(f" {w} " if n > 1 else w)[i : i + n] for i in range(len(f" {w} " if n > 1 else w) - n + 1)]
    grams = {n: {lang: Counter() for lang in languages} for n in range(1, 5)}
    for lang in languages:
        for w, count in words[lang].items():
            for n in grams:
                for g in cells(w, n):
                    grams[n][lang][g] += 1 + math.log(count)

    def chance(table, key):
        known = set().union(*table.values())
        if key not in known:
            return None
        return [math.log(table[lang][key] + 0.5) - math.log(sum(table[lang].values()) + 0.5 * len(known)) for lang in languages]

    total = [0.0] * len(languages)
    for w in letters(text):
        said = chance(words, w)
        for n in (4, 3, 2, 1):
            if said is None:
                parts = [p for g in cells(w, n) if (p := chance(grams[n], g)) is not None]
                said = [sum(x) / n for x in zip(*parts)] if parts else None
        total = [a + b for a, b in zip(total, said or [0.0] * len(languages))]
    best = max(range(len(languages)), key=lambda k: (total[k], -k))
    return (languages[best], 1 / sum(math.exp(t - total[best]) for t in total)) if letters(text) else ("und", 0.0)


def test_scores_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    labelled = [(r["lang"], r["text"]) for r in docs.where("doc_id % 9 = 0").collect()]
    texts = [r["text"][:150] for r in docs.where("doc_id % 20 = 1").collect()] + ["²½ Ⅷ", "x½y", "Ünïcode wörds, 12 of them", "qqq zzz", "日本 the", "", "!"]
    model = lg.train(docs.where("doc_id % 9 = 0"))
    got = {r["i"]: (r["lang_pred"], r["score"]) for r in lg.identify(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), model, keep=["i"]).collect()}
    for i, text in enumerate(texts):
        lang, score = brute(labelled, text)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-3
    assert got[len(texts) - 7] == ("und", 0.0)
