import random

from passagemill.functions import text
from passagemill.operators import chunk, store
from passagemill.sources import fixtures
from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_windows_are_those_of_packing_words():
    draw = random.Random(5)
    for _ in range(3000):
        words = ["".join(draw.choices("abü😀", k=draw.choice([1, 2, 5, 9, 18]))) for _ in range(draw.randrange(1, 60))]
        size, said = draw.choice([20, 33, 50]), " ".join(words)
        overlap = draw.choice([0, 5, 12, 19])
        assert chunk.split_text(said, size, overlap) == chunk._packed([words[0], *(" " + w for w in words[1:])], size, overlap)
    assert chunk.split_text("", 20, 5) == []


def test_white_space_in_columns_and_in_python(spark):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    draw = random.Random(6)
    said = ["".join(draw.choices([*spaces, " ", " ", "a", "é", "​", "᠎", "﻿", "\x00"], k=12)) for _ in range(3000)] + spaces + ["", " ", "a  b", "a b"]
    rows = spark.createDataFrame([(x,) for x in said], "t string").select("t", text.normalize_text(F.col("t")).alias("n")).collect()
    assert len(rows) == len(said)
    for r in rows:
        assert r["n"] == " ".join(r["t"].split())


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_need_no_labels(spark, sf):
    """Labels are no part of these results; joined, they deal out whole texts."""
    for name in ("chunk_by_profile", "chunk_standard", "chunk_stats"):
        assert "Join" not in _plan(entry.queries()[name](spark, sf))
    assert "quality" in fixtures.documents(spark, sf).columns


def test_texts_stay_where_nobody_reads_them(spark):
    rows = spark.range(5).selectExpr("cast(id % 2 as string) id", "id ingest_seq", "repeat('x', 9) text")
    window = _plan(store.last_of_each(rows).select("id")).split("Window", 1)[1]
    assert "text" not in window.split("Project", 1)[0].split("\n")[0]
    assert sorted(r["ingest_seq"] for r in store.last_of_each(rows).collect()) == [3, 4]
