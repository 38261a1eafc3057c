"""URL filters with redirect equivalence, in DataFrame functions only.

Rules name a host and the start of a path. A url's own longest rule decides: hosts are joined with those that rules name
at each of their dots, then the starts of their paths, at the lengths that those rules have, with the rules, so that
the number of rules is not in the plan. Urls that redirects or canonical links connect are aliases: a block by rule of
any of them blocks the others, except those with an allow rule of their own; all else is allowed.

Defined cases: null urls, and urls without ``://``, have an empty host and path, fit no rule and have no aliases;
a path must start with the rule's, so a url without a path fits no rule that has one; rules of one host and path are
one rule, the last one given; repeated pages repeat; links that are null, stand in a comment or point to the page itself
are ignored; all links of a page count; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import Workspace, labelled, saved

#: The contract's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Up to so many rules are broadcast (some 200 bytes each); more are joined as Spark sees fit.
BROADCAST_RULES = 10_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def resource(url: Column) -> Column:
    """What names the same resource: host, path and query, without scheme and fragment; null if there is no host."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    way = _plain_path(path(url))
    return F.when(host(url) != "", F.concat(host(url), F.when(way == "", "/").otherwise(way), query))


def _suffixes(host_: Column) -> Column:
    """The host, and what stands behind each of its dots."""
    labels = F.split(host_, r"\.")
    return F.transform(labels, lambda x, i: F.array_join(F.slice(labels, i + 1, F.size(labels) - i), "."))


def ruled(urls: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, rule, verdict) of the distinct hosts and paths among ``urls`` that a rule fits: its string and kind."""
    spark = urls.sparkSession
    known = {(name.translate(str.maketrans(UPPER, LOWER)), start): kind for kind, name, start in rules}
    said = json.dumps([{"name": name, "start": start, "verdict": kind} for (name, start), kind in known.items()])
    table = spark.range(1).select(F.explode(F.from_json(F.lit(said), "array<struct<name: string, start: string, verdict: string>>")).alias("r")).select("r.*")
    small = F.broadcast if len(known) <= BROADCAST_RULES else lambda rows: rows
    if len(known) > BROADCAST_RULES:
        table = saved(table, "rules")
    lengths = table.groupBy("name").agg(F.collect_set(F.length("start")).alias("lengths"))
    each = urls.where("host != ''").select("host", "path").distinct().select("host", "path", F.explode(_suffixes(F.col("host"))).alias("name"))
    tried = each.join(small(lengths), "name").select("host", "path", "name", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    fits = tried.select("host", "path", "name", F.expr("substring(path, 1, n)").alias("start")).join(small(table), ["name", "start"])
    rule = F.concat("name", "start")
    best = F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), F.col("verdict")))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def _plain_path(way: Column) -> Column:
    """A path without its ``.`` and ``..`` parts."""
    parts = F.split(way, "/")
    none = F.expr("cast(array() as array<string>)")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    end = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return F.when(way.rlike(r"/\.\.?(?:/|\z)"), F.concat(F.array_join(F.aggregate(parts, none, step), "/"), end)).otherwise(way)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) urls of all canonical links and refresh redirects in pages."""
    tag = lambda name, test: rf"(?is)<{name}\b(?=[^>]*{test})[^>]*?"
    body = F.regexp_replace(F.col(f"`{html}`"), r"(?s)<!--.*?(?:-->|\z)", "")
    canonical = tag("link", r"(?<![\w-])rel\s*=\s*(?:[\"'][^\"'>]*)?\bcanonical\b") + r"(?<![\w-])href\s*=\s*[\"']?([^\"'\s>]+)"
    refresh = tag("meta", r"(?<![\w-])http-equiv\s*=\s*[\"']?refresh\b") + r"\burl\s*=\s*[\"']?([^\"'\s>]+)"
    found = F.array_union(*[F.regexp_extract_all(body, F.lit(x), F.lit(1)) for x in (canonical, refresh)])
    at = pages.where(F.col(f"`{html}`").rlike(r"(?i)\bcanonical\b|\bhttp-equiv\b")).select(F.col(f"`{url}`").alias("source"), F.explode(found).alias("href"))
    scheme, base = F.regexp_extract("source", r"(?s)\A(.*?)://", 1), F.regexp_extract("source", r"(?s)\A(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("source", r"(?s)\A.*?://[^/?#]*((?:/[^?#/]*)*/)", 1)
    href = F.replace("href", F.lit("&amp;"), F.lit("&"))
    target = (
        F.when(href.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(base, href))
        .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), href))
    )
    return at.where("href != '' and source is not null").select("source", target.alias("target"))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, *, url: str = "url", html: str | None = "html", redirects: DataFrame | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, host, path, rule and verdict of each page.

    Links come from the pages' html and from ``redirects`` (source, target), such as a crawler's log.
    """
    spark, rules = pages.sparkSession, tuple(rules)
    links = [page_links(pages, url, html)] * (html is not None) + [r.select("source", "target") for r in [redirects] if r is not None]
    links = reduce(DataFrame.unionByName, links) if links else spark.range(0).selectExpr("'' as source", "'' as target")
    column, names = F.col(f"`{url}`"), [f"c{i}" for i in range(len(keep))]
    at = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], host(column).alias("host"), path(column).alias("path"), resource(column).alias("res"))
    with Workspace(spark) as work:
        said = ruled(at, rules).select(F.col("host").alias("host_"), F.col("path").alias("path_"), "rule", F.col("verdict").alias("own"))
        # A url without host and path fits no rule, however many rows have none; so these rows aren't dealt out by it.
        met = (F.col("host") == F.col("host_")) & (F.col("path") == F.col("path_")) & (F.col("host") != "")
        at = at.join(said, met, "left").drop("host_", "path_")
        edges = work.saved(links.select(resource(F.col("source")).alias("a"), resource(F.col("target")).alias("b")).where("a is not null and b is not null and a != b").distinct(), "links")
        if edges.isEmpty():
            verdict = F.coalesce("own", F.lit("allow"))
        else:
            members = work.saved(labelled(edges, work, task_edges=0), "members")  # without Python
            member = F.concat(F.lit("x://"), F.col("node"))
            members = members.select("node", "component", host(member).alias("host"), path(member).alias("path"))
            blocked = members.join(ruled(members, rules).where("verdict = 'block'"), ["host", "path"], "left_semi").select("component").distinct()
            aliases = saved(members.join(blocked, "component", "left_semi").select(F.col("node").alias("alias")), "aliases")
            at = at.join(aliases, F.col("res") == F.col("alias"), "left")
            verdict = F.coalesce("own", F.when(F.col("alias").isNotNull(), "block"), F.lit("allow"))
    return at.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "host", "path", "rule", verdict.alias("verdict"))
