"""Robots files as columns: their lines are folded into rules of a place, and the longest rule that fits a url decides.

One row of rules a place is joined to the urls, so no url is multiplied by rules; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import normalize_url, parts


def place_rules(files: DataFrame, agent: str = "*", *, place: str = "place", robots: str = "robots") -> DataFrame:
    """(place, rules): the rules for an agent in each place's robots file; places without any are left out.

    Consecutive ``user-agent`` lines begin a group, which goes on to the next such line after a rule; other lines, comments
    and empty rules say nothing. All groups that name the agent (by its name before ``/``, in any case) count together, and
    those of ``*`` if none does. Of several files of one place the least text counts.
    """
    token = agent.split("/")[0].strip().lower()
    one = files.select(F.lower(place).alias("place"), F.col(robots).alias("robots")).groupBy("place").agg(F.min("robots").alias("robots"))
    line = F.regexp_replace("line", r"#.*$", "")
    lines = one.select("place", F.posexplode(F.split("robots", "\r\n|\r|\n")).alias("pos", "line")).select("place", "pos", F.lower(F.trim(F.regexp_extract(line, r"^\s*([^:]*):", 1))).alias("key"), F.regexp_extract(line, r"^[^:]*:\s*(.*?)\s*$", 1).alias("value"))
    lines = lines.where(F.col("key").isin("user-agent", "allow", "disallow"))
    ordered = Window.partitionBy("place").orderBy("pos")
    begins = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(ordered), F.lit("")) != "user-agent")
    grouped = lines.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(ordered))
    names = F.when(F.col("key") == "user-agent", F.when(F.lower("value") == token, 2).when(F.col("value") == "*", 1).otherwise(0)).otherwise(0)
    fits = grouped.withColumn("fits", F.max(names).over(Window.partitionBy("place", "group"))).withColumn("best", F.max("fits").over(Window.partitionBy("place")))
    rules = fits.where("group > 0 AND fits = best AND fits > 0 AND key != 'user-agent' AND value != ''")
    return rules.groupBy("place").agg(F.collect_list(F.struct(F.length("value").alias("length"), (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"), _expression(F.col("value")).alias("expression"))).alias("rules"))


def _expression(pattern: Column) -> Column:
    """A regular expression for a pattern with ``*`` or a final ``$``; null for a plain prefix."""
    whole = pattern.endswith("$")
    body = F.when(whole, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    quoted = F.concat(F.lit("(?s)^\\Q"), F.replace(F.replace(body, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E"), F.when(whole, "\\z").otherwise(""))
    return F.when(whole | pattern.contains("*"), quoted)


def verdict(target: Column, rules: Column) -> Column:
    """Whether the longest rule that fits a path and query allows it; of equally long ones an allowing one wins, and what no
    rule fits is allowed, as is ``/robots.txt``."""
    fits = lambda r: F.when(r["expression"].isNull(), target.startswith(r["pattern"])).otherwise(F.rlike(target, r["expression"]))
    found = F.transform(F.filter(rules, fits), lambda r: F.struct(r["length"], r["allow"]))
    return (target == "/robots.txt") | F.coalesce(F.array_max(found)["allow"], F.lit(True))


def allowed(urls: DataFrame, files: DataFrame, agent: str = "*", *, url: str = "url") -> DataFrame:
    """The columns and ``robots_ok``, by the robots files (place, robots) of the urls' places; a place without one allows
    all, and so does a null url. Patterns meet paths and queries as they are written: escapes aren't decoded."""
    p = parts(normalize_url(F.col(url)))
    target = F.concat(F.when(p["path"] == "", "/").otherwise(p["path"]), F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""))
    known = place_rules(files, agent).select(F.col("place").alias("place_"), F.col("rules").alias("rules_"))
    return urls.join(known, p["place"] == F.col("place_"), "left").withColumn("robots_ok", verdict(target, F.col("rules_"))).drop("place_", "rules_")
