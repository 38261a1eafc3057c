"""Context blocks, prompts, payloads, and what comes back from a text generator, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import resolve_role

NOTHING = "No relevant documentation found."

# Our own wording.
SYSTEM = "You answer questions about an organisation's documents. Use only the passages given; name the source and page of what you use, and say so when the passages do not answer the question."
LEGEND = "A passage of category erd lists the boxes of a diagram under NODES and its arrows under EDGES, written as from -> to (label)."
TEMPLATES = {
    "developer": ("Reader: a developer. Be exact about tables, fields, interfaces and how they depend on one another.\n\n", True),
    "ba": ("Reader: a business analyst. Explain processes, rules and measures; leave out implementation unless asked.\n\n", False),
    "new_joiner": ("Reader: a new colleague. Start from the basics, explain terms when they first occur, and suggest what to read next.\n\n", False),
}


def context_blocks(hits: DataFrame, queries: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, context): numbered blocks of each query's passages in order of ``pos``; a fixed sentence if it has none."""
    number = F.row_number().over(Window.partitionBy(query).orderBy("pos"))
    said = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in hits.columns else F.lit(other)
    # The labels of a block.
    block = F.concat(
        F.lit("--- DOCUMENT CHUNK "), number.cast("string"), F.lit(" ---\nSOURCE: "), said("file_name", "?"), F.lit(" (Page "), said("page_number", "?"),
        F.lit(")\nCATEGORY: "), said("doc_type", "General"), F.lit(" / "), said("chunk_kind", "text"), F.lit("\nCONTENT: "), said("text", ""), F.lit("\n"),
    )
    rows = hits.select(query, number.alias("n"), block.alias("block"))
    whole = rows.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n").alias("context"))
    return queries.select(query).join(whole, query, "left").select(query, F.coalesce("context", F.lit(NOTHING)).alias("context"))


def user_prompt(query: Column, role: Column, context: Column, *, legend: bool = True) -> Column:
    """The prompt in the words of the role's template. The parts are joined, never substituted, so whatever a question
    or a passage holds stays as it is."""
    who = resolve_role(role)
    out = None
    for name, (opening, with_legend) in TEMPLATES.items():
        note = F.lit(f"CONTEXT LEGEND:\n{LEGEND}\n\n" if with_legend and legend else "")
        whole = F.concat(F.lit(opening), note, F.lit("CONTEXT:\n"), context, F.lit("\n\nQUESTION:\n"), query, F.lit("\n"))
        out = F.when(who == name, whole) if out is None else out.when(who == name, whole)
    return out


def chat_payload(messages: Column, model: str, temperature: float, top_p: float | None = None, max_tokens: int | None = None) -> Column:
    """A chat request as JSON; settings that are None stay out."""
    parts = [F.lit(model).alias("model"), messages.alias("messages"), F.lit(float(temperature)).alias("temperature")]
    parts += [F.lit(float(top_p)).alias("top_p")] if top_p is not None else []
    parts += [F.lit(int(max_tokens)).alias("max_tokens")] if max_tokens is not None else []
    return F.to_json(F.struct(*parts))


def messages(system: Column, user: Column, extra: Column | None = None) -> Column:
    """System, user, then further messages, an array of (role, content)."""
    two = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    return two if extra is None else F.concat(two, extra)


def content_payload(system: Column, user: Column, temperature: float, top_p: float | None = None, max_tokens: int | None = None) -> Column:
    """A request of the contents-and-instruction form as JSON."""
    settings = [F.lit(float(temperature)).alias("temperature")]
    settings += [F.lit(float(top_p)).alias("topP")] if top_p is not None else []
    settings += [F.lit(int(max_tokens)).alias("maxOutputTokens")] if max_tokens is not None else []
    part = lambda c: F.array(F.struct(c.alias("text")))
    return F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), part(user).alias("parts"))).alias("contents"), F.struct(part(system).alias("parts")).alias("systemInstruction"), F.struct(*settings).alias("generationConfig")))


def response_text(body: Column) -> Column:
    """The first choice's content, trimmed; empty if there is none."""
    return F.trim(F.coalesce(F.get_json_object(body, "$.choices[0].message.content"), F.lit("")))


def content_text(body: Column) -> Column:
    """All parts of the first candidate, joined and trimmed; empty if there is none."""
    parts = F.from_json(F.get_json_object(body, "$.candidates[0].content.parts"), "array<struct<text: string>>")
    return F.trim(F.coalesce(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.lit("")))


def line_data(line: Column) -> Column:
    """What a server-sent line carries; null if it is no data."""
    return F.when(line.startswith("data:"), F.trim(F.substring(line, 6, 1 << 30)))


def line_delta(data: Column) -> Column:
    """The piece of an answer in a line's data; null if it is no JSON of the expected form."""
    return F.get_json_object(data, "$.choices[0].delta.content")


def stream_deltas(lines: DataFrame, stream: str = "stream_id", order: str = "ord", line: str = "line") -> DataFrame:
    """(stream, order, delta) of server-sent lines up to the end mark; lines that are no data or no JSON say nothing."""
    at = lines.select(stream, order, line_data(F.col(line)).alias("data")).where("data IS NOT NULL")
    done = F.max((F.col("data") == "[DONE]").cast("int")).over(Window.partitionBy(stream).orderBy(order))
    return at.withColumn("done", done).where("done = 0").select(stream, order, line_delta(F.col("data")).alias("delta")).where("delta != ''")


def status_class(status: Column) -> Column:
    """ok, rate_limited, retriable or failed."""
    return F.when(status.between(200, 299), "ok").when(status == 429, "rate_limited").when(status.between(500, 599), "retriable").otherwise("failed")


def error_message(status: Column, body: Column) -> Column:
    """``HTTP`` and the status, with the error that a JSON body names, or else up to 300 characters of it."""
    named = F.coalesce(F.get_json_object(body, "$.error"), F.get_json_object(body, "$.message"), F.get_json_object(body, "$"))
    plain = F.when(body != "", F.substring(body, 1, 300))
    return F.concat(F.lit("HTTP "), status.cast("string"), F.coalesce(F.concat(F.lit(": "), F.coalesce(named, plain)), F.lit("")))


def backoff_seconds(attempt: Column, limited: Column, base: float = 0.8, factor: float = 1.8, limited_factor: float = 1.5, cap: float = 10.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt - 1) * F.when(limited, limited_factor).otherwise(1.0), F.lit(cap))
