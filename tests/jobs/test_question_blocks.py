"""Questions that are too many to broadcast are answered alike."""

from jobs import question_report
from passagemill.operators import sparse


def test_many_questions_are_answered_as_few_are(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the and w{i % 40} x{i % 7}", f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    turns = spark.createDataFrame([(i, "user", f"the w{i % 50} x{i % 9} y{i}" if i % 10 else "y y") for i in range(120)], "conv_id long, role string, text string")
    made, searched, before = [], [], sparse._in_blocks
    monkeypatch.setattr(sparse, "_in_blocks", lambda *a: searched.append(a[1]) or before(*a))
    for most in (sparse.BROADCAST_TERMS, 0):
        monkeypatch.setattr(sparse, "BROADCAST_TERMS", most)
        made.append(sorted(map(tuple, question_report.report(question_report.questions(turns), docs, 5, 1.0).collect()), key=repr))
    assert made[0] == made[1] and len(made[0]) > 500
    assert len(searched) == 2  # neither by joins of postings


def test_texts_of_distinct_ids_are_not_shuffled(spark):
    schema = "doc_id long, text string, source string"
    alone = spark.createDataFrame([(1, "a", "s"), (2, "b", "s")], schema)
    made = question_report.one_of_each(alone)
    assert "Exchange" not in made._jdf.queryExecution().toString() and made.count() == 2
    twice = question_report.one_of_each(alone.unionByName(spark.createDataFrame([(2, "b", "s"), (3, "c", "t")], schema)))
    assert sorted((r["doc_id"], r["text"]) for r in twice.collect()) == [(1, "a"), (2, "b"), (3, "c")]
