"""Robots rules in columns: groups, agents, wildcards, ends, ties and what is malformed."""

import pytest

from passagemill.sources import robots

FILES = [
    ("A.org", "User-agent: x\nDisallow: /\nUser-agent: bot\nDisallow: /p\nAllow: /p/open\nDisallow: /*.pdf$\nUser-agent: *\nDisallow: /q"),
    ("b.org", "User-agent: y\r\nUser-agent: BOT\r\n\r\nCrawl-delay: 3\r\nDisallow: /one # why\r\nUser-agent: z\r\nDisallow: /two\r\nUser-agent: bot\r\nDisallow: /three"),
    ("c.org", "Disallow: /before\nUser-agent: *\nDisallow:\nnonsense\nDisallow: /a(b\nDisallow: /t\nAllow: /t\nDisallow: /x\\Ey\nDisallow: /s*z*"),
    ("d.org", ""), ("e.org", None), (None, "User-agent: *\nDisallow: /"), ("f.org", "User-agent: *\nDisallow: /b"), ("f.org", "User-agent: *\nDisallow: /a"),
    ("g.org", "User-agent: *\nDisallow: /"), ("h.org", "User-agent: *\nDisallow: /*?session="),
]
CASES = {
    "http://a.org/p": False, "http://a.org/p/open/1": True, "http://a.org/p/other": False, "http://a.org/q": True, "http://a.org/z.pdf": False, "http://a.org/z.pdf?x=1": True, "http://a.org": True,
    "http://b.org/one": False, "http://b.org/two": True, "http://b.org/three": False,
    "http://c.org/before": True, "http://c.org/a(b": False, "http://c.org/t": True, "http://c.org/x\\Ey": False, "http://c.org/s-z": False, "http://c.org/s": True,
    "http://d.org/x": True, "http://e.org/x": True, "http://f.org/a": False, "http://f.org/b": True, "http://none.org/x": True,
    "http://g.org/": False, "http://g.org/robots.txt": True, "http://h.org/v?session=1": False, "http://h.org/v?s": True, "": True,
}


def test_cases_without_python_on_executors(spark):
    files = spark.createDataFrame(FILES, "place string, robots string")
    urls = spark.createDataFrame([(u, "kept") for u in [*CASES, None]], "url string, rules string")
    found = robots.allowed(urls, files, "Bot/2.1")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert {r["url"]: r["robots_ok"] for r in found.collect()} == CASES | {None: True}
    assert found.columns == ["url", "rules", "robots_ok"] and {r["rules"] for r in found.collect()} == {"kept"}


@pytest.mark.parametrize("agent, ok", [("x", False), ("other", False), ("bot", True)])
def test_groups_of_agents(spark, agent, ok):
    files = spark.createDataFrame(FILES[:1], "place string, robots string")
    assert robots.allowed(spark.createDataFrame([("http://a.org/q",)], "url string"), files, agent).first()["robots_ok"] is ok


def test_no_files_and_no_urls(spark):
    none = spark.createDataFrame([], "place string, robots string")
    urls = spark.createDataFrame([("http://a.org/q",)], "url string")
    assert robots.allowed(urls, none).first()["robots_ok"] is True
    assert robots.allowed(urls.limit(0), none).count() == 0
