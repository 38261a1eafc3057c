"""A breadth-first crawl, one level of all its pages at a time: over a table of fetched pages, or fetching each level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.html import page_links, with_text_and_title
from ..functions.urls import normalize_url, url_allowed


def crawl(spark: SparkSession, seed: str, pages: DataFrame | None, *, get: Callable[[DataFrame], DataFrame] | None = None, max_pages: int = 30, min_text_len: int = 100, same_site: bool = True, allow: tuple[str, ...] = (), deny: tuple[str, ...] = (), robots: Callable[[Column], Column] | None = None, bare_suffix: bool = False, url: str = "url", html: str = "html") -> DataFrame:
    """(pos, depth, url, text, title) of accepted pages in the order of their finding. Pages are those of a table, or what
    ``get`` makes of a level's urls: (url, html) of those that it gets.

    A page is accepted if its text is long enough; others still give links. It ends at ``max_pages`` accepted pages;
    at most ten times as many urls ever wait, which bounds every level's frontier and the loop's state.
    """
    if (pages is None) == (get is None):
        raise ValueError("crawl() needs a table of pages or a way to get them")
    table = None if pages is None else pages.select(normalize_url(F.col(url)).alias("url"), F.col(html).alias("html")).dropDuplicates(["url"])
    start = F.lit(seed)
    frontier = spark.range(1).select(normalize_url(start).alias("url"), F.lit(1).cast("long").alias("at"))
    seen = frontier.select("url")
    out: DataFrame | None = None
    accepted, known, depth = 0, 1, 0
    while True:
        if get is not None:
            got = get(frontier.select("url")).select("url", "html").collect()  # once, and at most ten times max_pages
            table = spark.createDataFrame(got, "url string, html string")
        met = with_text_and_title(frontier.join(table, "url"), "html")
        ok = F.length("text") >= min_text_len
        if robots is not None:
            ok &= robots(F.col("url"))
        before = F.coalesce(F.sum(ok.cast("long")).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        level = met.withColumns({"ok": ok, "before": before}).where(F.col("before") + accepted < max_pages)
        rows = level.select("url", "at", "ok", "text", "title", "html").collect()  # at most ten times max_pages
        level = spark.createDataFrame(rows, level.select("url", "at", "ok", "text", "title", "html").schema)
        good = level.where("ok").select(F.lit(depth).alias("depth"), "at", "url", "text", "title")
        out = good if out is None else out.unionByName(good)
        accepted += sum(r["ok"] for r in rows)
        if not rows or accepted >= max_pages:
            break
        found = page_links(level.withColumn("base", F.col("url")), "at", "base", "html")
        found = found.select(normalize_url(F.col("link")).alias("url"), F.struct("at", "pos").alias("key")).groupBy("url").agg(F.min("key").alias("key"))
        allowed = url_allowed(F.col("url"), normalize_url(start) if same_site else None, allow, deny, robots(F.col("url")) if robots else None, bare_suffix=bare_suffix)
        fresh = found.where(allowed).join(seen, "url", "left_anti")
        new = fresh.orderBy("key").limit(max(10 * max_pages - known, 0)).select("url").collect()
        seen = spark.createDataFrame([*(tuple(r) for r in seen.collect()), *(tuple(r) for r in new)], "url string") if new else seen
        known += len(new)
        depth += 1
        frontier = spark.createDataFrame([(r["url"], i) for i, r in enumerate(new, 1)], "url string, at long")
        if not new:
            break
    place = F.row_number().over(Window.orderBy("depth", "at"))
    return out.select(place.alias("pos"), "depth", "url", "text", "title")
