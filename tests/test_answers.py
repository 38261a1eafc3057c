"""Answers of a stream: whatever the order, repeats, restarts and ends of its lines."""

import random

import pytest
from pyspark.sql import functions as F

from passagemill.streaming import answers

LINES = "stream_id string, attempt long, ord long, line string, s long"


def said(word):
    return 'data: {"choices":[{"delta":{"content":"%s"}}]}' % word


def run(spark, base, batches):
    """The answers after each batch, every one run from the same checkpoint."""
    seen = []
    for rows in batches:
        made = spark.createDataFrame(rows, LINES).withColumn("at", F.timestamp_seconds("s")).drop("s")
        made.coalesce(1).write.mode("append").parquet(f"{base}/lines")
        answers.append(spark.readStream.schema(made.schema).parquet(f"{base}/lines"), f"{base}/out", f"{base}/checkpoint", delay="1 hour", patience=600)
        seen.append({tuple(r) for r in spark.read.schema(answers.ANSWERS).parquet(f"{base}/out").collect()})
    return seen


def test_cases(spark, tmp_path):
    first = [
        ("late", 0, 1, said("b"), 10), ("late", 0, 2, "data: [DONE]", 11),  # its first line comes with the second batch
        ("again", 0, 0, said("old"), 10), ("again", 0, 1, said("old"), 10),
        ("open", 0, 0, said("x"), 10), ("open", 0, 0, said("y"), 10), ("open", None, 1, said("z"), 10),  # never ends
        ("gap", 0, 0, said("a"), 10), ("gap", 0, 2, said("c"), 10), ("gap", 0, 3, "data: [DONE]", 10), ("gap", 0, 4, said("after"), 10),
        ("none", 0, 0, "data: [DONE]", 10), ("odd", 0, 0, "data: {broken", 10), ("odd", 0, 1, None, 10), ("odd", 0, 2, ": note", 10), ("odd", 0, 3, "data: [DONE]", 10),
        (None, 0, 0, said("a"), 10), ("no-ord", 0, None, said("a"), 10), ("no-at", 0, 0, said("a"), None),
    ]
    second = [
        ("late", 0, 0, said("a"), 12), ("late", 0, 1, said("B"), 12),
        ("again", 1, 1, "data: [DONE]", 12), ("again", 1, 0, said("new"), 12), ("again", 0, 2, "data: [DONE]", 12),
        ("none", 0, 0, "data: [DONE]", 12),  # a repeat gives no second answer
    ]
    seen = run(spark, tmp_path, [first, second, [("tick", 0, 5, "", 90_000)], [("open", 0, 9, said("too late"), 20)]])
    one = {("none", "", 0, True), ("odd", "", 0, True)}
    two = one | {("late", "ab", 2, True), ("again", "new", 1, True)}
    three = two | {("open", "xz", 2, False), ("gap", "ac", 2, False)}
    assert seen == [one, two, three, three]


def test_a_run_cut_by_restarts_gives_the_same(spark, tmp_path):
    rows = [(f"s{i}", 0, k, "data: [DONE]" if k == 9 else said(f"{i}.{k} "), 10) for i in range(40) for k in range(10)]
    random.Random(3).shuffle(rows)
    whole = run(spark, tmp_path / "whole", [rows])[-1]
    cut = run(spark, tmp_path / "cut", [rows[:150], rows[150:151], rows[151:] + rows[:50]])[-1]
    assert whole == cut == {(f"s{i}", "".join(f"{i}.{k} " for k in range(9)), 9, True) for i in range(40)}


def test_no_lines(spark, tmp_path):
    assert run(spark, tmp_path, [[]]) == [set()]
    with pytest.raises(Exception, match="attempt"):  # columns that are not there
        answers.answers(spark.readStream.schema("stream_id string, ord long, line string, at timestamp").parquet(str(tmp_path / "lines")))


def test_answers_of_one_bucket_stay_apart(spark, tmp_path):
    """Buckets bound the groups that go to Python; in the only one, each answer still ends, restarts and times out by itself."""
    batches = [
        [("quiet", 0, 0, said("q"), 10), ("quick", 0, 0, said("a"), 10), ("quick", 0, 1, "data: [DONE]", 10), ("slow", 0, 0, said("s"), 10), ("again", 0, 0, said("old"), 10)],
        [("slow", 0, 1, said("t"), 4_000), ("again", 1, 0, said("new"), 4_000), ("tick", 0, 1, "", 5_000)],  # quiet's patience is over, slow's and again's isn't
        [("slow", 0, 2, "data: [DONE]", 4_100), ("quick", 0, 0, said("b"), 4_100), ("again", 1, 1, "data: [DONE]", 4_100)],
    ]
    seen, states = [], []
    for rows in batches:
        made = spark.createDataFrame(rows, LINES).withColumn("at", F.timestamp_seconds("s")).drop("s")
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/lines")
        stream = answers.answers(spark.readStream.schema(made.schema).parquet(f"{tmp_path}/lines"), delay="1 hour", patience=600, buckets=1)
        query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        seen.append({tuple(r) for r in spark.read.schema(answers.ANSWERS).parquet(f"{tmp_path}/out").collect()})
    one = {("quick", "a", 1, True)}
    two = one | {("quiet", "q", 1, False)}
    assert seen == [one, two, two | {("slow", "st", 2, True), ("again", "new", 1, True)}]
    assert states == [1, 1, 1]


def test_many_answers_are_few_groups(spark, tmp_path):
    rows = [(f"s{i}", 0, k, "data: [DONE]" if k == 2 else said(f"{i}.{k} "), 10) for i in range(3000) for k in range(3)]
    made = spark.createDataFrame(rows, LINES).withColumn("at", F.timestamp_seconds("s")).drop("s")
    made.write.parquet(f"{tmp_path}/lines")
    query = answers.answers(spark.readStream.schema(made.schema).parquet(f"{tmp_path}/lines")).writeStream.option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024
    assert {tuple(r) for r in spark.read.schema(answers.ANSWERS).parquet(f"{tmp_path}/out").collect()} == {(f"s{i}", f"{i}.0 {i}.1 ", 2, True) for i in range(3000)}
