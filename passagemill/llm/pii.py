"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base matchers find e-mail addresses, IP addresses, card and phone numbers. They are the seeds: the words before a seed
are a lexical pattern of its kind. Identifier-like strings in what the base matchers leave are candidates; candidates
and seeds behind the same words make a bipartite graph of patterns and instances, which is scored in rounds: a pattern's
confidence is the share of its distinct instances that are believed, an instance's belief the noisy-or of its
patterns' confidences. A pattern counts if this share times the binary logarithm of the believed instances is high, so
that a pattern with much evidence may have many unseen instances. Candidates behind patterns that count are found as
further identifiers.

The graph holds identifier-like strings only, is aggregated before each shuffle, and never reaches the driver. Lists of
matches are built in pieces of CHUNK, so that the time of a text is nearly in proportion to its length and matches.

Defined cases: null text is empty; spans are code points, end exclusive; base spans of different kinds may overlap and
all stay, a candidate never overlaps a base span; repeated rows repeat, and add to no count of distinct instances;
with no seeds nothing more is found; extra columns are kept by ``redact`` and not read by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import Workspace, saved

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive repeats match the same strings and need no stack; a match that doesn't
#: follow another can't start inside a run of the characters that it starts with.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for its pattern to match; each test is a single scan.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Candidates: spelt-out addresses, and digits in groups.
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+\x00-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]++)++",
    "digits": r"(?<![A-Za-z0-9.+\x00-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}+(?![A-Za-z0-9\x00])",
}
CANDIDATE_HINTS = {"email": r"[(\[{]at[)\]}]", "digits": r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"}
#: Characters before a span, whose last words are its pattern.
CONTEXT_CHARS, CONTEXT_WORDS = 64, 2
ROUNDS = 3
#: What a pattern needs: believed instances, documents, the share of instances that are believed, and that share times
#: the binary logarithm of one more than the believed ones (the RlogF measure).
MIN_INSTANCES, MIN_DOCUMENTS, MIN_CONFIDENCE, MIN_SCORE = 5, 3, 0.5, 2.0
#: Matches that are appended to one another; lists of more are put together from such pieces.
CHUNK = 128
_SPAN = "array<struct<kind: string, start: int, end: int, value: string, before: string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    reverse = F.reverse(digits)
    each = F.transform(F.split(reverse, ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 3).cast("int") <= 255)
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _pieces(items: Column) -> Column:
    """A list that isn't empty in lists of CHUNK."""
    return _let(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda k: F.slice(x, k * CHUNK + 1, CHUNK)))


def _last(text: Column) -> Column:
    """The last characters, as many as a context has."""
    return F.substring(text, -CONTEXT_CHARS, CONTEXT_CHARS)


def _matches(text: Column, pattern: str, kind: str, hint: str) -> Column:
    """Array of (kind, start, end, value, before) of a pattern's matches: the lengths of what lies between them add up."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        before = _last(F.concat(acc["tail"], x["gap"]))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"), before.alias("before"))
        return F.struct(end.alias("at"), _last(F.concat(before, x["value"])).alias("tail"), F.concat(acc["out"], F.array(span)).alias("out"))

    def spans(piece: Column, head: Column) -> Column:
        return F.aggregate(piece, F.struct(head["at"].alias("at"), head["tail"].alias("tail"), _empty(_SPAN).alias("out")), step, lambda acc: acc["out"])

    def onward(acc: Column, piece: Column) -> Column:
        whole = F.array_join(F.transform(piece, lambda x: F.concat(x["gap"], x["value"])), "")
        here = F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"))
        return _let(whole, lambda w: F.struct((acc["at"] + F.length(w)).alias("at"), _last(F.concat(acc["tail"], w)).alias("tail"), F.concat(acc["out"], F.array(here)).alias("out")))

    def heads(pieces: Column) -> Column:
        """Where each piece begins, and the characters before it."""
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), _empty("array<struct<at: int, tail: string>>").alias("out"))
        return F.aggregate(pieces, zero, onward, lambda acc: acc["out"])

    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = lambda values: F.arrays_zip(values.alias("value"), F.slice(between, 1, F.size(values)).alias("gap"))
    all_ = _let(found, lambda values: F.when(F.size(values) > 0, _let(_pieces(pairs(values)), lambda ps: F.flatten(F.zip_with(ps, heads(ps), spans)))).otherwise(_empty(_SPAN)))
    return F.when(text.rlike(hint), all_).otherwise(_empty(_SPAN))


def _replaced(text: Column, spans: Column, first, more) -> Column:
    """The text with spans (not none, by start) replaced: ``first(span)`` stands for one that begins outside of those
    before it, ``more(span, end)`` for one that begins inside of what goes up to ``end``."""

    def piece(items: Column, begin: Column) -> Column:
        end = F.greatest(begin, F.array_max(F.transform(items, lambda x: x["end"])))

        def step(part: Column):
            def one(acc: Column, x: Column) -> Column:
                gap = F.substring(part, acc["at"] - begin + 1, x["start"] - acc["at"])
                apart = F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, first(x)).alias("out"))
                return F.when(x["start"] >= acc["at"], apart).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], more(x, acc["at"])).alias("out")))

            return one

        return _let(F.substring(text, begin + 1, end - begin), lambda part: F.aggregate(items, F.struct(begin.alias("at"), F.lit("").alias("out")), step(part), lambda acc: acc["out"]))

    def onward(acc: Column, items: Column) -> Column:
        end = F.greatest(acc["at"], F.array_max(F.transform(items, lambda x: x["end"])))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def whole(pieces: Column) -> Column:
        heads = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), _empty("array<int>").alias("out")), onward)
        return _let(heads, lambda h: F.concat(F.array_join(F.zip_with(pieces, h["out"], piece), ""), F.substring(text, h["at"] + 1, F.length(text) - h["at"])))

    return _let(_pieces(spans), whole)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value, before) of the base matches that hold, by kind, then start."""
    return F.concat(*[F.filter(_matches(text, PATTERNS[k], k, HINTS[k]), _holding(k)) for k in KINDS])


def _holding(kind: str):
    return lambda span: _holds(kind, span["value"])


def _is(kind: str):
    return lambda span: span["kind"] == kind


def _kind_of(digits: Column, value: Column) -> Column:
    """What a group of digits may be, by its form."""
    n = F.length(digits)
    return F.when(value.rlike(r"^\(?[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip").when(n.between(13, 19), "card").when(n.between(7, 12), "phone")


def _by_start(spans: Column) -> Column:
    """(start, end, kind) by start, of equal ones the longest first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), s["kind"].alias("kind"))))
    return F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), (-s["e"]).alias("end"), s["kind"].alias("kind")))


def _occurrences(rows: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end, value, context, seed) of seeds and candidates in texts."""
    at = rows.select("doc_id", "h", "text", base_spans(F.col("text")).cast(_SPAN).alias("base"))
    # Zeros stand for base spans, so that no candidate has a part of one.
    zeros = lambda n: F.repeat(F.lit("\0"), n)
    masked = _replaced(F.col("text"), _by_start(F.col("base")), lambda s: zeros(s["end"] - s["start"]), lambda s, end: zeros(F.greatest(s["end"] - end, F.lit(0))))
    left = F.when(F.size("base") > 0, masked).otherwise(F.col("text"))
    hinted = F.col("text").rlike("|".join(CANDIDATE_HINTS.values()))
    maybe = _let(left, lambda t: F.concat(*[_matches(t, CANDIDATES[k], k, CANDIDATE_HINTS[k]) for k in CANDIDATES]))
    at = at.select("doc_id", "h", "base", F.when(hinted, maybe).otherwise(_empty(_SPAN)).cast(_SPAN).alias("maybe")).where("size(base) > 0 or size(maybe) > 0")
    marked = lambda seed: lambda s: F.struct(s.alias("s"), F.lit(seed).alias("seed"))
    spans = F.concat(F.transform("base", marked(True)), F.transform("maybe", marked(False)))
    each = at.select("doc_id", "h", F.explode(spans).alias("x")).select("doc_id", "h", "x.s.*", "x.seed")
    words = F.regexp_extract_all(F.lower("before"), F.lit(r"([\p{L}]+)"), F.lit(1))
    context = F.when(F.size(words) >= CONTEXT_WORDS, F.concat_ws(" ", F.slice(words, -CONTEXT_WORDS, CONTEXT_WORDS)))
    kind = F.when(F.col("kind") == "digits", _kind_of(_digits(F.col("value")), F.col("value"))).otherwise(F.col("kind"))
    return each.select("doc_id", "h", kind.alias("kind"), "start", "end", F.lower("value").alias("value"), context.alias("context"), "seed").where("kind is not null")


def patterns(occurrences: DataFrame, work: Workspace, *, rounds: int = ROUNDS) -> DataFrame:
    """(kind, context, confidence) of the patterns that are believed after so many rounds."""
    known = occurrences.where("context is not null")
    texts = work.saved(known.groupBy("kind", "context").agg(F.count_distinct("h").alias("documents")).where(F.col("documents") >= MIN_DOCUMENTS).select("kind", "context"), "contexts")
    graph = work.saved(known.groupBy("kind", "context", "value").agg(F.max(F.col("seed").cast("int")).alias("seed")).join(texts, ["kind", "context"], "left_semi"), "graph")
    belief = graph.withColumn("belief", F.col("seed").cast("double"))
    for turn in range(rounds):
        scored = belief.groupBy("kind", "context").agg(F.count(F.lit(1)).alias("instances"), F.sum("belief").alias("believed"))
        scored = scored.withColumn("confidence", F.col("believed") / F.col("instances"))
        scored = scored.where((F.col("believed") >= MIN_INSTANCES) & (F.col("confidence") >= MIN_CONFIDENCE) & (F.col("confidence") * F.log2(F.col("believed") + 1) >= MIN_SCORE))
        scored = work.saved(scored.select("kind", "context", "confidence"), "patterns")
        if turn + 1 < rounds:
            doubt = graph.join(scored, ["kind", "context"]).groupBy("kind", "value").agg(F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))).alias("doubt"))
            belief = graph.join(doubt, ["kind", "value"], "left").withColumn("belief", F.when(F.col("seed") == 1, 1.0).otherwise(1 - F.coalesce("doubt", F.lit(1.0))))
    return scored


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body, F.length(body)).alias("h"), body.alias("text"))


def discovered(rows: DataFrame) -> DataFrame:
    """(id, h, more): of each text with further identifiers, their spans."""
    with Workspace(rows.sparkSession) as work:
        found = work.saved(_occurrences(rows), "occurrences")
        return saved(_spans_of(found, patterns(found, work)), "extra")


def _spans_of(found: DataFrame, good: DataFrame) -> DataFrame:
    extra = found.where("not seed").join(good, ["kind", "context"]).select("doc_id", "h", F.struct("kind", "start", "end").alias("s")).distinct()
    return extra.groupBy(F.col("doc_id").alias("id"), F.col("h").alias("key")).agg(F.collect_set("s").alias("more"))


def _with_spans(rows: DataFrame, carried: list[str]) -> DataFrame:
    """The columns, ``base`` and ``spans``: arrays of (kind, start, end) by kind as listed, then start."""
    extra = discovered(rows)
    order = F.expr("map(" + ", ".join(f"'{k}', {i}" for i, k in enumerate(KINDS)) + ")")
    base = F.transform(base_spans(F.col("text")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    at = rows.withColumn("base", base).join(extra, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key")), "left")
    ranked = F.array_sort(F.transform(F.concat("base", "more"), lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return at.select(*carried, "base", spans.alias("spans"))


def _said(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end); the base matches, and all that was found."""
    return _with_spans(_rows(docs, doc_id, text), ["doc_id"])


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of base spans, and all spans as a string."""
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_said("base"), 256).alias("base_sha256"), _said("spans").alias("spans"))


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns as they came; in the text each span is replaced by its kind in brackets. Overlapping spans merge and
    take the kind of the one that starts first (the longer, if two do)."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.toDF(*names)
    key, body = names[docs.columns.index(doc_id)], names[docs.columns.index(text)]
    whole = F.coalesce(F.col(body), F.lit(""))
    rows = at.select(*names, F.col(key).alias("doc_id"), F.xxhash64(whole, F.length(whole)).alias("h"), whole.alias("text"))
    marked = _with_spans(rows, [*names, "text"])
    cut = _replaced(F.col("text"), _by_start(F.col("spans")), lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")), lambda s, end: F.lit(""))
    new = F.when(F.size("spans") > 0, cut).otherwise(F.col(body))
    return marked.select(*[(new if n == body else F.col(n)).alias(c) for n, c in zip(names, docs.columns)])
