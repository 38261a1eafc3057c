"""Cases that the driver's tables never exercise."""

import dataclasses
import io
import json
import random
import zipfile
import zlib
from urllib.parse import urldefrag, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.config import ChunkConfig, EngineConfig, GeneratorConfig, RetrievalConfig, SourceConfig, StoreConfig, api_key
from passagemill.engine import RetrievalEngine
from passagemill.functions import embed, html, text, urls
from passagemill.operators import chunk, dense, generate, prompt, rank, retrieve, sparse, store
from passagemill.operators.crawl import crawl
from passagemill.plans import literals
from passagemill.sources import files, fixtures, pdf
from passagemill.streaming import ingest
from passagemill.workspace import Workspace


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_white_space_is_what_python_strips(spark):
    every = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    assert len(every) == 29
    said = [f" a{c}{c}b{c}" for c in every] + [None, "", "a​b", "﻿a"]
    assert column(spark, said, text.normalize_text) == [" ".join((x or "").split()) for x in said]


def test_ids_and_roles(spark):
    import hashlib

    rows = [("h", "t", "s", "f", 1), ("", " a  b", None, "f", None), (None, "é", "", "", 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string, t string, s string, f string, p int").select(text.row_id(*map(F.col, "htsfp"))).collect()]
    assert got == ["h", hashlib.sha256(b"a b|f|0").hexdigest()[:32], hashlib.sha256("é|unknown|0".encode()).hexdigest()[:32]]
    assert column(spark, ["capital.pdf", "USER_guide.pdf", None], text.name_type) == ["api", "product", "unknown"]
    assert column(spark, [" DEV ", None, "nobody"], text.resolve_role) == ["developer"] * 3


def plain_url(url):
    url = (url or "").strip()
    if not url:
        return url
    url = url if urlparse(url).scheme else "https://" + url
    p = urlparse(urldefrag(url)[0])
    return f"{p.scheme.lower()}://{p.netloc.lower()}{p.path or '/'}" + (f"?{p.query}" if p.query else "")


def test_urls(spark):
    given = ["HTTP://A.b/P;x/q;y?Q#f", "a.b", None, "", " \t", "https://h:1", "https://h/?", "//h/x", "a.b:80/x;y", "mailto:x@y.z", "foo://a/b;c", "x:", "https:/x", "https:///x", "http://h;p", "http://h/a;b;c", "http://h/?a;b/c", "q?x=1;2", "HTTPS://H/%41#?"]
    given += literals.URLS
    assert column(spark, given, urls.normalize_url) == [plain_url(u) for u in given]
    assert column(spark, ["https://a.example.com:8/x", "https://evilexample.com/"], lambda c: urls.same_site(c, F.lit("https://example.com"))) == [True, False]


def slow_pack(pieces, size, overlap):
    out, window, total = [], [], 0
    for p in pieces:
        if total + len(p) > size and window:
            out.append("".join(window).strip())
            while total > overlap or (total + len(p) > size and total > 0):
                total -= len(window.pop(0))
        window.append(p)
        total += len(p)
    return [x for x in [*out, "".join(window).strip()] if x]


def test_chunks_of_random_and_long_words():
    rng = random.Random(2)
    for _ in range(300):
        words = ["w" * rng.choice([1, 2, 5, 9, 19, 20, 21, 55]) for _ in range(rng.randrange(1, 40))]
        said, want, run = " ".join(words), [], []
        for i, w in enumerate(words):
            piece = w if i == 0 else " " + w
            if len(piece) < 20:
                run.append(piece)
            else:
                want += slow_pack(run, 20, 6) + slow_pack(list(piece), 20, 6)
                run = []
        want += slow_pack(run, 20, 6)
        assert chunk.split_text(said, 20, 6) == want and all(len(c) <= 20 for c in want)
    assert chunk.chunk_texts("x" * 19, False, ChunkConfig()) == ([], 0)
    long, n = chunk.chunk_texts("word " * 121 + "end", False, ChunkConfig(merge_short_tail=True))
    assert n == 1 and len(long) == 1


def test_chunks_are_the_same_over_partitions(spark):
    rows = [(i, "word " * (i * 40) + str(i), "schema" if i % 2 else None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc_type string")
    one, many = (sorted(tuple(r) for r in chunk.chunk(docs.repartition(n)).collect()) for n in (1, 7))
    assert one == many and len(one) > 30


def test_pages_and_links(spark):
    page = "<title> T </title><header><h1>no</h1></header><div class='SubMenu'>no</div><p>a&amp;b<table><tr><td>cell</table><h1>H <b>1</b></h1><p id=cookie-bar>no"
    assert html.text_and_title(page) == ("T a&b cell H 1", "T")
    assert html.text_and_title(page.replace("<title> T </title>", ""), True) == ("a&b H 1", "H 1")
    assert html.text_and_title(None) == ("", "")
    assert html.links("<a href='b#x'><a href='//c.d/e'><a href=mailto:x><a href='b'><a>", "https://a.b/c/") == ["https://a.b/c/b", "https://c.d/e", "https://a.b/c/b"]


def test_crawl_limits(spark):
    page = lambda *to: "<p>" + "word " * 40 + "".join(f"<a href='{x}'></a>" for x in to)
    pages = spark.createDataFrame([("https://s.org/", page(*[f"/{i}" for i in range(40)]))] + [(f"https://s.org/{i}", page("/", f"/{i + 1}")) for i in range(40)], "url string, html string")
    got = [r["url"] for r in crawl(spark, "https://s.org", pages, max_pages=3).orderBy("pos").collect()]
    assert got == ["https://s.org/", "https://s.org/0", "https://s.org/1"]
    barred = crawl(spark, "s.org", pages, max_pages=3, robots=lambda u: ~u.endswith("/0"))
    assert [r["url"] for r in barred.orderBy("pos").collect()] == ["https://s.org/", "https://s.org/1", "https://s.org/2"]
    assert crawl(spark, "https://nowhere.org", pages).count() == 0


def test_fusion_against_a_loop(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for q in range(60):
        score, first = {}, {}
        for l in range(2):
            for r in range(1, rng.randrange(1, 9)):
                d = rng.randrange(6)
                rows.append((q, f"d{d}", l, r))
                score[d] = score.get(d, 0) + 1 / (60 + r)
                first.setdefault(d, (l, r))
        want[q] = [f"d{d}" for d in sorted(score, key=lambda d: (-round(score[d], 12), first[d]))][:4]
    got = {}
    for r in rank.fuse(spark.createDataFrame(rows, "query_id long, id string, list_no int, rank int"), 4).orderBy("query_id", "pos").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {k: v for k, v in want.items() if v}


def test_interleaving_against_a_loop(spark):
    rng = random.Random(4)
    kinds = ["technical", "product", "web", None, "api", "functional"]
    rows, want = [], {}
    for q in range(80):
        docs = [(i, rng.choice(kinds)) for i in range(1, rng.randrange(2, 10))]
        rows += [(q, i, k) for i, k in docs]
        tech, func = ([d for d in docs if d[1] in some] for some in (rank.TECHNICAL, rank.FUNCTIONAL))
        out = docs
        if tech and func:
            out = [x for i in range(max(len(tech), len(func))) for x in func[i : i + 1] + tech[i : i + 1]]
            out += docs[len(out) :]
        want[q] = [i for i, _ in out]
    frame = spark.createDataFrame([(q, i, i, k) for q, i, k in rows], "query_id long, pos int, id int, doc_type string")
    got = {}
    for r in rank.interleaved(frame).orderBy("query_id", "pos").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == want


def test_dense_plan_batches_and_missing_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, vector array<float>")
    asked = rows.where("id < 7").withColumnRenamed("id", "query_id")
    for kind in ("cosine", "dot", "l2"):
        got = dense.top(asked, rows, 5, distance=kind).collect()
        v = rows.where("id < 300").alias("v").join(F.broadcast(asked.withColumnRenamed("vector", "q")))
        want = sparse.top(v.select("query_id", "id", dense.similarity(F.col("q"), F.col("vector"), kind).alias("score")), 5).collect()
        assert sorted((r["query_id"], r["rank"], r["id"]) for r in got) == sorted((r["query_id"], r["rank"], r["id"]) for r in want)
    assert dense.top(asked.limit(0), rows, 5).collect() == []
    with pytest.raises(ValueError):
        dense.top(asked, rows, 5, distance="manhattan")


def test_ties_of_a_batch_stay_k_rows(spark):
    rows = spark.createDataFrame([(f"k{i:04d}", [1.0, 0.0], i % 2) for i in range(3000, 0, -1)], "id string, vector array<float>, label int")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<float>")
    one = dense.top(asked, rows.coalesce(1), 3)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in one.collect()) == [(q, n, f"k{n:04d}") for q in (1, 2) for n in (1, 2, 3)]
    assert sorted((r["query_id"], r["label"], r["id"]) for r in dense.top(asked, rows, 1, by="label").collect()) == [(q, l, f"k{2 - l:04d}") for q in (1, 2) for l in (0, 1)]


def test_hybrid_filters_before_dense_and_after_sparse(spark):
    docs = spark.createDataFrame([(f"p{i}", f"apple pear t{i}", [1.0, float(i)], "s" if i % 2 else None, "api", i % 2) for i in range(30)], "id string, text string, vector array<float>, source string, doc_type string, quality int")
    asked = spark.createDataFrame([(1, "apple t4", [1.0, 4.0], "dev"), (2, "nothing", None, "ba")], "query_id long, text string, vector array<float>, role string")
    got = retrieve.hybrid(asked, docs, filters={"quality": 1}, k=4).collect()
    assert len(got) == 4 and {r["query_id"] for r in got} == {1} and all(r["quality"] == 1 for r in got)
    wide = retrieve.hybrid(asked, docs, filters={"quality": 1}, k=4, config=RetrievalConfig(prefilter_sparse=True, resolve_role=True)).collect()
    assert len(wide) == 4
    contexts = {r[0]: r[1] for r in prompt.context_blocks(retrieve.hybrid(asked, docs), asked).collect()}
    assert contexts[2] == prompt.NOTHING and contexts[1].startswith("--- DOCUMENT CHUNK 1 ---\nSOURCE: ? (Page ?)\nCATEGORY: api / text\n")


def test_a_saved_index_scores_alike(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 5 + 1))) for i in range(40)] + [(99, None), (100, "  ")], "id long, text string")
    asked = spark.createDataFrame([(1, "w0 w0 w3"), (2, "w9"), (3, None)], "query_id long, text string")
    index = sparse.postings(docs), sparse.lengths(docs)
    a, b = (sorted((r[0], r[1], round(r[2], 9)) for r in sparse.scores(asked, docs, index=i).collect()) for i in (None, index))
    assert a == b and {q for q, _, _ in a} == {1}


@pytest.mark.parametrize("direct", [0, sparse.DIRECT])
def test_the_best_are_found_without_scoring_all(spark, monkeypatch, direct):
    monkeypatch.setattr(sparse, "DIRECT", direct)
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(30_000)]
    texts = [" ".join(words[rng.randrange(29_000) :][: rng.randrange(1, 60)]) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:30] + ["w1 w1 w1", "w2", "", None])), "id long, text string")
    asked = [(q, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for q in range(60)] + [(100, "w1"), (101, "w1 w2 w1"), (102, "none"), (103, None), (104, "w1 none " + words[7])]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = sparse.postings(docs), sparse.lengths(docs)
    rows = lambda frame: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in frame.collect())
    for k in (1, 5, 1000):
        want = rows(sparse.top(sparse.scores(queries, docs), k))
        assert rows(sparse.search(queries, docs, k)) == want == rows(sparse.search(queries, docs, k, index=index))


def test_few_documents_of_one_term_are_scored(spark, monkeypatch):
    """Documents that share only a common word with a query come from no other words."""
    monkeypatch.setattr(sparse, "DIRECT", 0)
    docs = spark.createDataFrame([(i, f"the and of x{i % 300} y{i}" + " rare" * (i % 50 == 0)) for i in range(3000)], "id long, text string")
    queries = spark.createDataFrame([(q, f"the and of rare x{q}") for q in range(20)], "query_id long, text string")
    seen, before = [], Workspace.saved
    try:
        Workspace.saved = lambda self, df, what="table": seen.append((what, before(self, df, what))) or seen[-1][1] if what != "brought" else seen.append((what, df.count())) or before(self, df, what)
        assert sparse.search(queries, docs, 5).count() == 100
    finally:
        Workspace.saved = before
    assert dict(seen)["brought"] < 20 * 80  # of 20 * 3000


def test_prompts_keep_what_looks_like_a_placeholder(spark):
    row = spark.createDataFrame([("{context} $1 \\", "ba", "{query}")], "q string, r string, c string")
    said = row.select(prompt.user_prompt(F.col("q"), F.col("r"), F.col("c"))).first()[0]
    assert "{context} $1 \\" in said and "{query}" in said and "LEGEND" not in said
    assert "LEGEND" not in row.select(prompt.user_prompt(F.col("q"), F.lit("dev"), F.col("c"), legend=False)).first()[0]
    errors = spark.createDataFrame([(400, '{"error":"bad"}'), (503, "down"), (404, "")], "s int, b string").select(prompt.error_message(F.col("s"), F.col("b"))).collect()
    assert [r[0] for r in errors] == ["HTTP 400: bad", "HTTP 503: down", "HTTP 404"]


@pytest.fixture
def config(tmp_path):
    return EngineConfig(store=StoreConfig(path=str(tmp_path / "store"), dim=16))


def test_store_versions_upserts_and_promotion(spark, config):
    s = store.PassageStore(spark, config.store)
    schema = "id string, text string, vector array<float>, ingest_seq long, kind string"
    rows = spark.createDataFrame([("a", "1", None, 1, "x"), ("a", "2", [0.5] * 16, 2, None), ("b", "3", None, 3, "y")], schema)
    assert s.count() == 0 and s.rows() is None and s.upsert(rows.limit(0)) == 0
    assert s.upsert(rows) == 3 and s.count() == 2 and s.count({"kind": None}) == 1
    old = s.rows()
    assert s.upsert(rows.where("id = 'b'").withColumn("text", F.lit("4"))) == 1
    assert {r["text"] for r in s.rows().collect()} == {"2", "4"} and {r["text"] for r in old.collect()} == {"2", "3"}
    with pytest.raises(store.StoreError):
        s.upsert(spark.createDataFrame([("c", "1", [1.0], 1, "x")], schema))
    assert s.delete_matches({"kind": "y"}) == 1 and s.delete_matches({}) == 0 and s.delete_matches({"kind": "none"}) == 0
    assert s.delete_ids(spark.createDataFrame([("a",), ("zz",)], "id string")) == 2 and s.count() == 0
    name = s.rebuild(rows)
    assert s.resolve() == name and s.count() == 2
    with pytest.raises(store.StoreError):
        s.rebuild(rows.limit(0))
    with pytest.raises(store.StoreError):
        s.promote("nowhere")
    assert s.resolve() == name
    with pytest.raises(ValueError):
        store.to_distance("taxicab")


def test_store_parts_are_merged_and_old_ones_go(spark, config, tmp_path):
    settings = dataclasses.replace(config.store, max_parts=3, merge_share=10.0, keep_versions=1)
    s, want = store.PassageStore(spark, settings), {}
    schema = "id string, text string, vector array<float>, ingest_seq long"
    for turn in range(7):
        rows = [(f"k{(turn * 3 + i) % 8}", f"text {turn} {i}", None, turn * 10 + i) for i in range(4)]
        assert s.upsert(spark.createDataFrame(rows, schema)) == 4
        want |= {k: t for k, t, _, _ in rows}
        if turn == 4:
            s.delete_ids(spark.createDataFrame([("k1",), ("zz",)], "id string"))
            want.pop("k1", None)
        assert {r["id"]: r["text"] for r in s.rows().collect()} == want and s.count() == len(want)
        posted, sizes = s.index()
        assert sorted((r["id"], r["term"]) for r in posted.collect()) == sorted((k, w) for k, t in want.items() for w in set(t.split()))
        assert {r["id"] for r in sizes.collect()} == set(want)
        assert 1 <= len(s._parts(s.resolve())) <= 3
    live = {p["path"] for p in s._parts(s.resolve())}
    there = {x.name for x in (tmp_path / "store" / s.resolve()).iterdir() if x.is_dir()}
    assert live <= there and len(there) <= 3 + 3 + 1


def test_equal_orders_have_one_winner(spark):
    rows = [("a", str(i), {"m": i}, 1) for i in range(20)]
    made = [spark.createDataFrame(random.Random(n).sample(rows, 20), "id string, text string, m map<string, int>, ingest_seq long").repartition(n + 1) for n in range(3)]
    assert len({store.last_of_each(m).first()["text"] for m in made}) == 1


def docx(*parts):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(p(x) if isinstance(x, str) else "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in x) + "</w:tbl>" for x in parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_office_files_and_pages_of_pdf(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/user_guide.docx").write_bytes(docx("First  paragraph of it", "", [["a", " ", "b"], ["", ""]], "Second"))
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "erd.pdf").write_bytes(b"one two\x0cthree")
    found = files.files(spark, str(tmp_path), ".docx")
    whole = files.docx_documents(found).collect()
    assert [(r["text"], r["chunk_kind"], r["doc_type"], r["file_name"], r["page_number"]) for r in whole] == [("First paragraph of it Second a | b", "text", "product", "user_guide.docx", 1)]
    split = files.docx_documents(found, SourceConfig(per_file_document=False, min_text_len=2, infer_type=False)).collect()
    assert sorted((r["chunk_kind"], r["text"], r["doc_type"]) for r in split) == [("text_paragraphs", "First paragraph of it Second", "unknown"), ("text_tables", "a | b", "unknown")]
    assert files.files(spark, str(tmp_path), ".docx", recursive=False).count() == 1

    def reader(content):
        return [{"text": t, "has_images": True, "image": b"i", "diagram": None} for t in content.decode().split("\x0c")]

    pdf = files.pdf_documents(files.files(spark, str(tmp_path), ".pdf"), reader, ocr=lambda image: "read by a machine, at last", max_pages=1)
    assert [(r["page_number"], r["chunk_kind"], r["doc_type"]) for r in pdf.collect()] == [(1, "ocr", "erd")]


def test_robots_fetching_and_web_pages(spark):
    at = spark.createDataFrame([("https://A.org/x",), ("https://a.org/private/y",), ("https://b.org/",)], "url string")
    rules = spark.createDataFrame([("a.org", "User-agent: *\nDisallow: /private")], "place string, robots string")
    assert {r["url"]: r["robots_ok"] for r in files.robots_allowed(at, rules).collect()} == {"https://A.org/x": True, "https://a.org/private/y": False, "https://b.org/": True}

    def client():
        def get(address):
            if "b.org" in address:
                raise OSError
            return address, "text/html; charset=x", "<p>" + "word " * 30

        return get

    fetched = files.fetch(at, client)
    assert fetched.where("html = ''").count() == 1
    got = files.web_documents(fetched, content_type="content_type").collect()
    assert sorted(r["source"] for r in got) == ["https://a.org/private/y", "https://a.org/x"] and {r["doc_type"] for r in got} == {"web"}


def test_live_pages_obey_robots_files(spark, config):
    def client():
        pages = {"https://a.org/robots.txt": "User-agent: *\nDisallow: /no", "https://a.org/yes": "<p>" + "word " * 40, "https://a.org/no": "<p>" + "word " * 40}
        return lambda address: (address, "text/html", pages[address])

    engine = RetrievalEngine(spark, config)
    assert engine.ingest_urls(["a.org/yes", "https://a.org/no", "https://b.org/gone"], client=client) == 1
    assert engine.store.rows().first()["source"] == "https://a.org/yes"


def test_diagrams_as_json(spark):
    from passagemill.operators import diagram
    from passagemill.plans.queries import _geometry

    got = {r["page_key"]: r["diagram"] for r in diagram.diagram_json(*_geometry(spark)).collect()}
    assert set(got) == {1, 2, 4} and got[4]["edges"] == [] and got[4]["title"] == ""
    assert got[1]["title"] == "Order model" and [n["id"] for n in got[1]["nodes"]] == ["so_mstr", "sod_det", "pt_mstr"]
    assert [tuple(e) for e in got[1]["edges"]] == [("so_mstr", "sod_det", "1:n"), ("sod_det", "pt_mstr", None)]


def test_retries_and_replies(spark):
    config, slept = GeneratorConfig(), []
    replies = iter([generate.Reply(503, ""), OSError("gone"), generate.Reply(429, ""), generate.Reply(200, "ok")])

    def client(_):
        r = next(replies)
        if isinstance(r, OSError):
            raise r
        return r

    assert generate.request(client, "{}", config, slept.append).body == "ok" and slept == [0.8, 0.8 * 1.8, 0.8 * 1.8**2 * 1.5]
    with pytest.raises(generate.GenerationError):
        generate.request(lambda _: generate.Reply(400, "bad"), "{}", config, slept.append)
    with pytest.raises(generate.GenerationError):
        generate.request(lambda _: generate.Reply(500, ""), "{}", config, slept.append)
    assert api_key({"OPENROUTER_API_KEY": " k "}) == "k" and api_key({"OPENROUTER_KEY_FILE": "/nowhere"}) is None


def test_streams_of_pieces():
    config, slept, payload = GeneratorConfig(), [], '{"messages":[]}'
    said = lambda *x: (200, iter(x))
    piece = lambda x: f'data: {{"choices":[{{"delta":{{"content":"{x}"}}}}]}}'
    replies = iter([(503, iter([])), OSError("gone"), said("", ": note", piece("a"), "data: {broken", 'data: {"choices":[]}', piece("b"), "data: [DONE]", piece("late"))])

    def client(asked):
        assert json.loads(asked)["stream"] is True
        r = next(replies)
        if isinstance(r, OSError):
            raise r
        return r

    assert list(generate.stream(client, payload, config, slept.append)) == ["a", "b"] and len(slept) == 2
    with pytest.raises(generate.GenerationError):
        list(generate.stream(lambda _: (400, iter(["bad"])), payload, config, slept.append))
    with pytest.raises(generate.GenerationError):
        list(generate.stream(lambda _: (500, iter([])), payload, config, slept.append))


def test_clients_over_http():
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            refused = "refuse" in body
            self.send_response(429 if refused else 200)
            self.end_headers()
            if self.headers.get("Accept") == "text/event-stream" and not refused:
                self.wfile.write(b'data: {"choices":[{"delta":{"content":"x"}}]}\n\ndata: [DONE]\n')
            else:
                self.wfile.write(json.dumps([self.path, self.headers.get("Authorization"), self.headers.get("x-goog-api-key")]).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    config = GeneratorConfig(model="m", base_url=f"http://127.0.0.1:{server.server_port}/v1")
    assert json.loads(generate.http_client(config, "k")()("{}").body) == ["/v1", "Bearer k", None]
    assert json.loads(generate.content_client(config, "k")()("{}").body) == ["/v1/models/m:generateContent", None, "k"]
    assert generate.http_client(config, "k")()('"refuse"').status == 429
    assert list(generate.stream(generate.stream_client(config, "k"), "{}", config)) == ["x"]
    server.shutdown()


def test_pdf_files_that_cannot_be_read_are_reported(spark, config, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(docx("A paragraph that is long enough."))
    (tmp_path / "in/good.pdf").write_bytes(fixtures.pdf_bytes([b"BT /F 10 Tf 50 700 Td (A line that is long enough) Tj ET"]))
    (tmp_path / "in/bad.pdf").write_bytes(b"no file")
    engine = RetrievalEngine(spark, config)
    with pytest.raises(RuntimeError, match="1 PDF.*bad.pdf.*not a PDF"):
        engine.ingest_path(str(tmp_path / "in"))
    with pytest.warns(UserWarning, match="1 PDF"):
        assert engine.ingest_path(str(tmp_path / "in"), skip_unreadable=True) == 2


def test_pdf_reading():
    show = lambda content, **more: pdf.reader(fixtures.pdf_bytes([content], **more))[0]
    page = show(b"q 2 0 0 2 0 0 cm BT /F 10 Tf 20 300 Td [(Wor) -10 (ld) -400 (t\\(w\\)\\157)] TJ 0 -12 Td <4142> Tj ET Q 10 10 30 20 re f 5 5 m 5 60 l 90 60 l S 0 0 m 9 9 l 9 9 8 8 7 7 c s")
    assert page["text"] == "World t(w)o\nAB" and not page["has_images"]
    assert page["drawings"] == [("rect", (10, 770, 40, 790), None), ("line", None, [(5, 795), (5, 740), (90, 740)]), ("curve", None, [(0, 800), (9, 791), (7, 793)])]
    assert show(b"BT /F 10 Tf 1 0 0 1 300 500 Tm (right) Tj 1 0 0 1 50 500 Tm (left) Tj 1 0 0 1 50 700 Tm (top) Tj ET", packed=False)["text"].split() == ["top", "left", "right"]
    assert show(b"BI /W 1 /H 1 ID \x00\xff EI BT /F 9 Tf 9 9 Td (x) Tj ET")["has_images"]
    # two-byte codes with a map, a compressed object, a form in a form, and a picture
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00E9> endbfchar 1 beginbfrange <0005> <0007> <0061> endbfrange"
    inner = b"<</Type/Font/Subtype/Type0/DescendantFonts[<</DW 500>>]/ToUnicode 7 0 R>>"
    packed = zlib.compress(b"6 0 " + inner)
    parts = [
        b"1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj", b"2 0 obj<</Kids[3 0 R]/Count 1>>endobj",
        b"3 0 obj<</Type/Page/MediaBox[0 0 100 100]/Contents[4 0 R]/Resources<</Font<</A 6 0 R>>/XObject<</X 8 0 R/I 9 0 R>>>>>>endobj",
        b"4 0 obj<</Length 9 >>stream\n/X Do /I Do\nendstream endobj", b"5 0 obj<</Type/ObjStm/N 1/First 4/Filter/FlateDecode>>stream\n" + packed + b"\nendstream endobj",
        b"7 0 obj<<>>stream\n" + cmap + b"\nendstream endobj", b"8 0 obj<</Subtype/Form/Matrix[1 0 0 1 5 5]>>stream\nBT /A 10 Tf 1 1 Td <00010005000600070009> Tj ET\nendstream endobj",
        b"9 0 obj<</Subtype/Image/Filter/DCTDecode>>stream\nJPEG\nendstream endobj",
    ]
    page = pdf.reader(b"%PDF-1.5\n" + b"\n".join(parts))[0]
    assert page["text"] == "éabc\ufffd" and page["image"] == b"JPEG"
    for bad in (b"", b"%PDF-1.4", b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj trailer<</Root 1 0 R/Encrypt 9 0 R>>"):
        with pytest.raises(ValueError):
            pdf.reader(bad)


def test_live_crawl_and_main_extractors(spark, config):
    def client():
        word = "<p>" + "word " * 40
        pages = {"https://a.org/robots.txt": "User-agent: *\nDisallow: /no", "https://a.org/": word + "<a href=/yes><a href=/no><a href=/pdf>", "https://a.org/yes": word, "https://a.org/no": word, "https://a.org/pdf": word}
        return lambda address: (address, "application/pdf" if "pdf" in address else "text/html", pages[address])

    engine = RetrievalEngine(spark, config)
    assert engine.crawl("https://a.org", client=client) == 2
    assert {r["source"] for r in engine.store.rows().collect()} == {"https://a.org/", "https://a.org/yes"}
    page = "<title>T</title><nav>n</nav><p>body"
    assert html.main_text_and_title(page, lambda p: {"text": " main  text ", "title": "M"}) == ("main text", "M")
    assert html.main_text_and_title(page, lambda p: "x") == ("x", "T")
    assert html.main_text_and_title(page, lambda p: " ") == html.main_text_and_title(page, lambda p: 1 / 0) == ("T body", "T")


def test_engine_from_documents_to_answers(spark, config, tmp_path):
    engine = RetrievalEngine(spark, dataclasses.replace(config, retrieval=RetrievalConfig(interleave=False)))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/manual.docx").write_bytes(docx("The warehouse ships orders on working days before noon."))
    assert engine.ingest_path(str(tmp_path / "in"), reader=lambda b: []) == 1
    pages = spark.createDataFrame([("https://s.org/api", "<p>" + " ".join(f"Endpoint {i} lists invoices by customer." for i in range(30)))], "url string, html string")
    n = engine.ingest_pages(pages)
    assert n > 1 and engine.crawl("https://s.org/api", pages) == n and engine.store.count() == 1 + n
    asked = spark.createDataFrame([(1, "When does the warehouse ship orders?", "ba"), (2, "Which endpoint lists invoices?", "dev")], "query_id long, text string, role string")
    best = {r["query_id"]: r["source"] for r in engine.retrieve(asked).where("pos = 1").collect()}
    assert best[1].endswith("manual.docx") and best[2] == "https://s.org/api"
    with pytest.raises(RuntimeError):
        engine.ask(asked)
    engine.set_client(generate.echo_client)
    assert all(r["answer"].endswith("characters") and r["error"] is None for r in engine.ask(asked).collect())
    name = engine.rebuild_from_path(str(tmp_path / "in"), reader=lambda b: [])
    assert engine.store.resolve() == name and engine.store.count() == 1


def test_streaming_ingest_equals_batch(spark, config, tmp_path):
    docs = spark.createDataFrame([(i, "word " * 200 + str(i), "web") for i in range(12)], "doc_id long, text string, doc_type string")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    s = store.PassageStore(spark, config.store)
    for _ in range(2):  # the second finds nothing new
        ingest.start(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs")), s, str(tmp_path / "ckpt")).awaitTermination(120)
    assert {r["id"] for r in s.rows().collect()} == {r["id"] for r in ingest.passages(docs).collect()}


def test_embedding_fills_only_gaps(spark):
    rows = spark.createDataFrame([("a b", [1.0, 0.0]), ("a b", None)], "text string, vector array<float>")
    got = sorted([list(r["vector"]) for r in embed.with_vectors(rows, embed.hashing_embedder(2)).collect()])
    assert [1.0, 0.0] in got and len(got) == 2


def test_sparse_filter_stays_above_the_cut_and_scans_are_pruned(spark, sf):
    from passagemill.plans.queries import QUERIES

    cut = {(r["query_id"], r["id"], r["rank"]) for r in QUERIES["bm25_topk"](spark, sf).collect()}  # ranks stay those of the cut
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    assert {(r["query_id"], r["id"], r["rank"]) for r in QUERIES["bm25_postfilter"](spark, sf).collect()} == {x for x in cut if x[1] in good}
    read = QUERIES["min_len_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in read
    pushed = store.filtered(spark.read.parquet(f"{sf}/labels.parquet"), {"toxic": 1})._jdf.queryExecution().executedPlan().toString()
    assert "EqualNullSafe(toxic,1)" in pushed or "EqualTo(toxic,1)" in pushed
