import os
import random
import subprocess
import sys

from jobs import passage_feed as feed
from passagemill.config import ChunkConfig
from passagemill.operators.chunk import chunk_texts

SCHEMA = "doc_id long, text string, lang string, source string, batch int, id string"


def put(spark, path, rows):
    """Another file of documents; columns with the job's own names are none of its business."""
    spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def want(docs):
    out = []
    for doc_id, text, lang, source in docs:
        parts, total = chunk_texts(" ".join((text or "").split()), False, ChunkConfig(technical_types=()))
        out += [(doc_id, source, i, total, said, lang or "und") for i, said in parts]
    return sorted(out, key=str)


def got(spark, out):
    rows = feed.current(spark, out).collect()
    assert len({r["id"] for r in rows}) == len({(r["source"], r["text"]) for r in rows})
    return sorted(((r["doc_id"], r["source"], r["chunk_index"], r["chunk_total"], r["text"], r["lang"]) for r in rows), key=str)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_growing_changed_repeated_and_emptied_documents(spark, tmp_path):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    one = [(1, words("a", 300), "en", "s"), (2, words("b", 50), None, None), (3, words("c", 40), "", "s"), (4, "short", "en", "s"), (None, words("d", 20), "fr", "s"), (None, words("e", 20), "fr", "s"), (5, None, "en", "s"), (6, words("f", 90), "de", "s")]
    put(spark, docs, one + one[:2])
    assert feed.run(spark, docs, out, mark) == 1
    assert got(spark, out) == want(one)
    before = files(f"{out}/passages")
    assert feed.run(spark, docs, out, mark) == 0 and files(f"{out}/passages") == before

    put(spark, docs, [(1, words("a", 300), "en", "s"), (2, words("changed", 60), "en", "s"), (6, "", "de", "s"), (7, words("g", 700), "es", "t"), (None, words("d", 20), "fr", "s")])
    assert feed.run(spark, docs, out, mark) == 1
    now = [one[0], (2, words("changed", 60), "en", "s"), *one[2:5], one[5], (7, words("g", 700), "es", "t")]
    assert got(spark, out) == want(now)
    fresh = spark.read.schema(feed.PASSAGES).parquet(f"{out}/passages").where("batch = 1")
    assert {r["doc_id"] for r in fresh.select("doc_id").distinct().collect()} == {2, 7}, "what didn't change isn't cut again"
    assert before.items() <= files(f"{out}/passages").items(), "earlier batches stay as they are"

    put(spark, docs, [(6, words("f", 90), "de", "s")])  # back again as it was
    feed.run(spark, docs, out, mark)
    assert got(spark, out) == want([*now, one[7]])


def test_several_files_a_batch_and_several_batches(spark, tmp_path):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    known: list[str] = []
    for k in range(3):
        put(spark, docs, [(1, words(f"v{k}", 30), "en", "s"), (10 + k, words("w", 30 + k), "en", "s")])
        for f in sorted(x for x in os.listdir(docs) if x.endswith(".parquet") and x not in known):
            known.append(f)
            os.utime(os.path.join(docs, f), (1_000_000 + 10 * len(known),) * 2)  # the clock of files is coarse
    assert feed.run(spark, docs, out, mark, {"max_files_per_batch": 2}) == 2
    assert got(spark, out) == want([(1, words("v2", 30), "en", "s"), *((10 + k, words("w", 30 + k), "en", "s") for k in range(3))])


def test_a_batch_that_broke_off_is_made_good(spark, tmp_path):
    out = str(tmp_path / "out")
    schema = "doc_id long, text string, lang string, source string, modified timestamp, file string"
    rows = lambda said: spark.createDataFrame([(1, said, "en", "s", None, "f"), (2, words("k", 40), "de", "s", None, "f")], schema)
    settings = feed.settings("passage_feed")
    feed.take_batch(rows(words("a", 40)), 0, out, settings)
    feed.take_batch(rows(words("b", 40)), 1, out, settings)
    first = got(spark, out)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/ledger/batch=1")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # passages were written, the ledger wasn't
    assert got(spark, out) == want([(1, words("a", 40), "en", "s"), (2, words("k", 40), "de", "s")])
    feed.take_batch(rows(words("b", 40)), 1, out, settings)
    feed.take_batch(rows(words("b", 40)), 1, out, settings)
    assert got(spark, out) == first == want([(1, words("b", 40), "en", "s"), (2, words("k", 40), "de", "s")])


def test_empty_tables_and_settings_stay(spark, tmp_path):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    put(spark, docs, [])
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    feed.run(spark, docs, out, mark)
    put(spark, docs, [(1, words("a", 30), "en", "s")])
    feed.run(spark, docs, out, mark)
    assert got(spark, out) == want([(1, words("a", 30), "en", "s")])
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_command_line(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    put(spark, docs, [(1, words("a", 300), "en", "s")])
    (tmp_path / "my.json").write_text('{"size": 200}')
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    args = ["-m", "jobs.passage_feed", "--documents", docs, "--out", out, "--checkpoint", str(tmp_path / "mark"), "--config", str(tmp_path / "my.json")]
    said = subprocess.run([sys.executable, *args], cwd=root, capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_LOCAL_DIRS": str(tmp_path)})
    assert said.returncode == 0, said.stderr[-2000:]
    assert "read 1 rows; 1 documents new or changed; wrote" in said.stderr
    assert max(len(r[4]) for r in got(spark, out)) <= 200


def test_texts_stay_where_they_were_read(spark, tmp_path, monkeypatch):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    one = [(i, words(f"a{i}.", 10), "en", "s") for i in range(3000)]
    plans, write = [], feed._write

    def planned(rows, path, *partitions):
        plans.append((os.path.basename(path), rows._jdf.queryExecution().executedPlan().toString()))
        write(rows, path, *partitions)

    monkeypatch.setattr(feed, "_write", planned)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # so 3,000 keys are many
    try:
        put(spark, docs, one)  # all are new
        feed.run(spark, docs, out, mark)
        put(spark, docs, [*one[1:], (0, words("b", 10), "en", "s")])  # one has changed
        feed.run(spark, docs, out, mark)
        rows = feed.current(spark, out)
        plans.append(("current", rows._jdf.queryExecution().executedPlan().toString()))
        assert got(spark, out) == want([(0, words("b", 10), "en", "s"), *one[1:]])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    kinds = [k for k, _ in plans if k != "ledger"]
    assert kinds == ["passages", "passages", "current"]
    assert not [k for k, plan in plans if k != "ledger" and "Exchange hashpartitioning" in plan]


def test_random_batches_as_plain_python(spark, tmp_path):
    """New, changed, unchanged, repeated and nameless documents in every mixture, against a dictionary."""
    rng, out, known = random.Random(5), str(tmp_path / "out"), {}
    schema = "doc_id long, text string, lang string, source string, modified timestamp, file string"
    settings = feed.settings("passage_feed")
    for number, changing in enumerate((1.0, 0.1, 0.6)):
        rows, texts, newest = [], [], {}
        for doc_id in [*range(40), *rng.choices(range(40), k=12), *[None] * 12]:
            texts.append(words(f"t{rng.randrange(3)}.", 20) if doc_id is None else words(f"d{doc_id}.v{number if rng.random() < changing else 0}.", 20))
            said = rng.choice(("%s", "  %s", "%s\n")) % texts[-1].replace(" ", rng.choice((" ", "\t ")))
            rows.append((doc_id, said, "en", "s", None, f"f{rng.randrange(4)}"))
        hashes = [r["content"] for r in feed._content(feed._keyed(spark.createDataFrame(rows, schema))).select("content").collect()]
        for (doc_id, *_, file), text, content in zip(rows, texts, hashes):
            key = text if doc_id is None else doc_id
            newest[key] = max(newest.get(key, ("", "", ())), (file, content, (doc_id, text, "en", "s")))
        known |= {k: v[2] for k, v in newest.items()}
        feed.take_batch(spark.createDataFrame(rows, schema), number, out, settings)
        assert got(spark, out) == want(known.values())
