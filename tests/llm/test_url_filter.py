import random
import re

import duckdb
from pyspark.sql import DataFrame

from passagemill.llm import queries
from passagemill.llm import url_filter as uf

LINK = '<link rel="canonical" href="{}">'


def judged(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.judge(pages, **options).collect()}


def test_rules_and_odd_urls(spark):
    urls = {
        1: "https://Example.com/en/1?x#y", 2: "http://www.example.com/en/", 3: "http://m.www.example.com/en/z", 4: "http://a.example.com/en/1", 5: "http://example.com/fr/",
        6: "http://x.net/es/1", 7: "http://x.net/de/", 8: "http://notexample.com/en/", 9: None, 10: "no scheme", 11: "", 12: "http://example.com", 13: "http://example.com?/en/", 14: "a://b.com://c/en/", 15: "http://net/fr/",
    }
    got = judged(spark, [(k, u, None) for k, u in urls.items()])

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    assert got == {k: brute(u) for k, u in urls.items()}
    assert got[1][3] == "block" and got[3][3] == "allow" and got[12] == ("example.com", "", None, "allow")


def test_aliases_take_blocks_and_own_allows_win(spark):
    rows = [
        (1, "http://a.org/1", LINK.format("http://x.net/es/9")),  # of a blocked page that is not in the table
        (2, "https://b.org/2?q=1#f", '<META http-equiv=refresh content="0; url=//a.org/1">'),  # over an alias
        (3, "http://c.com/3", LINK.format("http://a.org/1")),  # its own rule allows it
        (4, "http://d.org/4", LINK.format("http://c.com/3")),  # an allowed alias passes the block on
        (5, "http://e.org/5", LINK.format("/6")),
        (6, "http://e.org/6", None),
        (7, "http://f.org/7", '<a href="http://x.net/es/9" rel="next">canonical</a>'),
    ]
    got = {k: v[3] for k, v in judged(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "allow"}


def test_chains_of_links_against_sql(spark, tmp_path):
    rng = random.Random(8)
    hosts = ["a.org", "b.org", "Example.com", "www.example.com", "x.net", "c.com", "m.x.net"]
    rows, last = [], "http://x.net/es/0"
    for i in range(1500):
        url = f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'de', 'p/q'])}/{i}" + rng.choice(["", "?k=1", "#f", "?a=1&b=2"])
        kind, to = rng.randrange(6), last if rng.random() < 0.6 else f"http://{rng.choice(hosts)}/{rng.choice(['en', 'fr', 'z'])}/{rng.randrange(400)}"
        html = [
            None,
            f'<link rel="canonical" href="{to}">',
            f"<LINK href={to.replace('&', '&amp;')} rel='nofollow canonical'>",
            f'<meta content="3; URL={to}" http-equiv="Refresh">',
            f'<!-- <link rel="canonical" href="{to}"> --><link rel="canonical" href="{i}.html"><link rel=canonical href="//a.org/en/{i % 50}">',
            '<link rel="stylesheet" href="http://x.net/es/1"><link data-rel="canonical" href="http://x.net/es/1">',
        ][kind]
        rows.append((i, url, html))
        last = url if rng.random() < 0.8 else "http://a.org/fresh"
    rows += [(1500, None, None), (1501, "none", None), (1502, "http://a.org/x", "<link rel=canonical href='http://x.net/es/5'><link rel=canonical href='http://b.org/y'>"), (1503, "http://b.org/y", None)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(path)
    got = {tuple(r) for r in queries.op1_url_filters(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = set(db.execute(queries.OP1).fetchall())
    assert got == want and len(want) == len(rows)
    assert sum(r[3] is None and r[4] == "block" for r in want) > 200  # by aliases


def test_dots_in_paths_and_all_links(spark):
    rows = [(1, "http://a.org/d/1", LINK.format("http://x.net/de/../es/./9")), (2, "http://a.org/d/2", "<!--" + LINK.format("http://x.net/es/9") + "-->"), (3, "http://a.org/d/3", LINK.format("http://a.org/d/2") + LINK.format("../d/x/../1"))]
    assert {k: v[3] for k, v in judged(spark, rows).items()} == {1: "block", 2: "block", 3: "block"}


def test_many_rules(spark):
    rng = random.Random(9)
    rules = [(rng.choice(["allow", "block"]), f"h{rng.randrange(3000)}.{rng.choice(['net', 'org'])}", "/" + "p" * rng.randrange(40)) for _ in range(12_000)]
    urls = [f"http://{rng.choice(['', 'a.', 'b.c.'])}h{rng.randrange(3000)}.{rng.choice(['net', 'org'])}/{'p' * rng.randrange(50)}" for _ in range(500)]

    def brute(url, table):
        host, path = re.match("http://([^/]*)(.*)", url).groups()
        fits = [(len(h + p), h + p, v) for (h, p), v in table.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, "allow")

    for some in (rules, rules[:2000]):
        table = {(h, p): v for v, h, p in some}
        got = judged(spark, [(i, u, None) for i, u in enumerate(urls)], rules=some)
        assert {i: v[2:] for i, v in got.items()} == {i: brute(u, table) for i, u in enumerate(urls)}


def test_redirect_log_empty_and_clashing_columns(spark):
    log = spark.createDataFrame([("http://e.org/6", "http://y.net/fr/1"), (None, "http://z"), ("http://e.org/6", "http://e.org/6")], "source string, target string")
    assert judged(spark, [(6, "http://e.org/6", None), (6, "http://e.org/6", None)], redirects=log)[6][3] == "block"
    assert judged(spark, [], redirects=log) == {}
    pages = spark.createDataFrame([(1, "http://y.net/fr/", "", "h", "r", "n")], "page_id long, url string, html string, host string, rule string, node string")
    assert uf.judge(pages).select("rule", "verdict").first() == ("net/fr/", "block")


def test_no_python_in_the_plan(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(20).selectExpr("page_id", "url", "concat(html, '<link rel=canonical href=http://x.net/es/', page_id % 3, '>') as html")
    seen = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda *a, **k: seen.append(a))
    plan = uf.judge(pages)._jdf.queryExecution().toString()
    assert not seen and not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
