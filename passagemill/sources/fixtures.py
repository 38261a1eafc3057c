"""The driver's tables as documents and questions of a retrieval engine, by fixed rules."""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
import zlib
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.generate import Client, Reply

# What a document's type and a question's role are, by id modulo the length.
DOC_TYPES = ("technical", "schema", "erd", "functional", "product", "analytics", "reporting", "onboarding", "user_guide", "api", "web", "unknown")
ROLES = ("developer", "ba", "new_joiner", "dev")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def described(rows: DataFrame) -> DataFrame:
    """doc_id, text, source of rows of documents, with doc_type, file_name and page_number."""
    docs = rows.select("doc_id", "text", "source").withColumn("doc_type", _pick(DOC_TYPES, "doc_id"))
    return docs.withColumns({"file_name": F.concat("doc_type", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")), "page_number": (F.col("doc_id") % 5).cast("int")})


def documents(spark: SparkSession, sf_dir: str, *, vectors: bool = False, labels: bool = True, head: int | None = None) -> DataFrame:
    """doc_id, text (or so many characters of it), file_name, source, page_number, doc_type, quality and toxic unless they
    are not wanted, which spares shuffling texts, and the vector if asked for."""
    rows = table(spark, sf_dir, "documents")
    rows = rows if head is None else rows.withColumn("text", F.substring("text", 1, head))
    docs = described(rows)
    if labels:
        docs = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    if vectors:
        docs = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")
    return docs


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text, vector, role of every benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return items.join(vectors, "query_id", "left").withColumn("role", _pick(ROLES, "query_id"))


#: Characters of a piece of an answer.
PIECE = 40


def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, attempt, ord, line, at, arrival): every assistant's text as server-sent lines, which arrive mixed over
    three hours. Each fifth conversation's first attempt broke off and was sent again; each seventh's answers never end."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant' AND text != ''").select("conv_id", "turn", "text")
    n = F.ceil(F.length("text") / PIECE).cast("long")
    ends = F.when(F.col("conv_id") % 7 != 0, F.array(F.struct(n.alias("ord"), F.lit("data: [DONE]").alias("line"))))
    json = lambda i: F.to_json(F.struct(F.array(F.struct(F.struct(F.substring(F.col("text"), (i * PIECE + 1).cast("int"), F.lit(PIECE)).alias("content")).alias("delta"))).alias("choices")))
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(i.alias("ord"), F.concat(F.lit("data: "), json(i)).alias("line")))
    stream = F.concat_ws("-", "conv_id", "turn")
    whole = said.select(stream.alias("stream_id"), (F.col("conv_id") % 5 == 0).cast("long").alias("attempt"), F.explode(F.concat(pieces, F.coalesce(ends, F.array().cast("array<struct<ord: long, line: string>>")))).alias("x")).select("stream_id", "attempt", "x.*")
    broken = said.where("conv_id % 5 = 0").select(stream.alias("stream_id"), F.lit(0).cast("long").alias("attempt"), F.lit(0).cast("long").alias("ord"), F.lit('data: {"choices":[{"delta":{"content":"broken off"}}]}').alias("line"))
    arrival = F.when(F.col("attempt") == 0, F.col("ord") % 3).otherwise(1 + F.col("ord") % 2)
    return whole.unionByName(broken).withColumn("arrival", arrival.cast("int")).withColumn("at", F.timestamp_seconds(86_400 + F.col("arrival") * 3600 + F.col("ord") % 60))


def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): every document as an office file, a paragraph for each line, the last one in a table."""
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    @F.udf("binary", useArrow=True)
    def made(text):
        lines = [f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in re.split("[\r\n]+", text or "")]
        body = "".join(lines[:-1]) + f"<w:tbl><w:tr><w:tc>{lines[-1]}</w:tc></w:tr></w:tbl>"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
        return out.getvalue()

    path = F.concat(F.lit("/docs/"), _pick(DOC_TYPES, "doc_id"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".docx"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), made("text").alias("content"))


def pdf_bytes(contents: list[bytes], packed: bool = True) -> bytes:
    """A PDF file with a page for each stream of drawing operators, in which /F is a Latin font."""
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/MediaBox[0 0 600 800]/Count %d/Kids[%s]>>" % (len(contents), b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(contents)))), b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding/FirstChar 0/Widths[%s]>>" % b" ".join([b"600"] * 256)]
    for k, said in enumerate(contents):
        objects.append(b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F 3 0 R>>>>/Contents %d 0 R>>" % (5 + 2 * k))
        data = zlib.compress(said) if packed else said
        objects.append(b"<</Length %d%s>>stream\n%s\nendstream" % (len(data), b"/Filter/FlateDecode" * packed, data))
    out, places = bytearray(b"%PDF-1.5\n"), []
    for number, said in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (number, said)
    table = b"".join(b"%010d 00000 n \n" % x for x in places)
    return bytes(out) + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, table, len(objects) + 1, len(out))


def _lines(text: str, x: float, y: float, size: float = 8) -> bytes:
    shown = [b"(" + re.sub(rb"([\\()])", rb"\\\1", line.encode("cp1252", "replace")) + b") Tj T*" for line in text.split("\n")]
    return b"BT /F %g Tf %g TL %g %g Td %s ET" % (size, 1.25 * size, x, y, b"\n".join(shown))


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): every document as a PDF file: its lines on a page, and two boxes with a line between on another."""

    @F.udf("binary", useArrow=True)
    def made(text, number):
        boxes = b"100 600 120 40 re S 320 600 120 40 re S 220 620 m 320 620 l S"
        labels = [_lines("Model of a document", 60, 760, 12), _lines(f"order_{number} head", 105, 620), _lines(f"line_{number} rows", 325, 620), _lines("1:n", 262, 626)]
        return pdf_bytes([_lines("\n".join(re.split("[\r\n]+", text or "")), 40, 770), boxes + b"\n" + b"\n".join(labels)])

    path = F.concat(F.lit("/docs/"), _pick(DOC_TYPES, "doc_id"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), made("text", "doc_id").alias("content"))


def article(page: str) -> str | None:
    """A main extractor for the fixtures' pages, which finds nothing in those of an odd length."""
    m = re.search("<article>(.*?)</article>", page, re.S)
    return html.unescape(re.sub("<[^>]*>", " ", m[1])) if m and len(page) % 2 == 0 else None


def repeating_client() -> Client:
    """Repeats the question, and refuses those whose length is a multiple of five."""

    def reply(payload: str) -> Reply:
        asked = json.loads(payload)["messages"][-1]["content"]
        return Reply(400, '{"error":"no"}') if len(asked) % 5 == 0 else Reply(200, json.dumps({"choices": [{"message": {"content": f"said: {asked}"}}]}))

    return reply
