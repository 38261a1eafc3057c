from pyspark.sql import functions as F

from passagemill.config import StoreConfig
from passagemill.operators import store


def _rows(spark, ids):
    rows = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, ingest_seq long")
    return rows.select("id", F.concat(F.lit("text "), F.col("ingest_seq").cast("string")).alias("text"), F.lit(None).cast("array<float>").alias("vector"), "ingest_seq", F.coalesce("id", F.lit("none")).alias("kind"))


def test_distinct_ids_are_written_without_dealing_out_texts(spark, tmp_path, monkeypatch):
    """Rows of distinct ids are written as they come."""
    s = store.PassageStore(spark, StoreConfig(path=str(tmp_path), dim=4))

    def never(*_):
        raise AssertionError("texts are dealt out")

    monkeypatch.setattr(store, "last_of_each", never)
    assert s.upsert(_rows(spark, ["a", "b", "c", None])) == 4
    assert s.rows().count() == 4


def test_the_last_of_each_id_is_written(spark, tmp_path):
    ids = ["a", "b", "a", None, "c", None, "b", "a"]
    for k, layout in enumerate(({}, {"sort_by": ("kind",), "bloom": ("kind",)})):
        s = store.PassageStore(spark, StoreConfig(path=f"{tmp_path}/{k}", dim=4, **layout))
        assert s.upsert(_rows(spark, ids)) == 8
        assert sorted((r["id"] or "", r["ingest_seq"]) for r in s.rows().collect()) == [("", 5), ("a", 7), ("b", 6), ("c", 4)]
        assert not [p for p in tmp_path.rglob("*-given")] + [p for p in tmp_path.rglob("*-again")]


def test_ranges_follow_the_size(spark, tmp_path, monkeypatch):
    """What one task sorts doesn't grow with the table."""
    monkeypatch.setattr(store, "RANGE_BYTES", 100)
    s = store.PassageStore(spark, StoreConfig(path=str(tmp_path), dim=4, sort_by=("kind",)))
    asked = []
    before = s._write_rows
    monkeypatch.setattr(s, "_write_rows", lambda rows, path, tasks=None: (asked.append(tasks), before(rows, path, tasks))[1])
    s.upsert(_rows(spark, [f"k{i}" for i in range(300)]))
    assert asked[0] > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert s.rows().count() == 300
