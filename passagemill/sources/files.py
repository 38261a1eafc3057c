"""Office documents, PDF files and fetched pages as document rows."""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SourceConfig
from ..functions.html import MainText, with_text_and_title
from ..functions.text import name_type, normalize_text, now_iso, url_type
from ..functions.urls import normalize_url, parts
from ..operators import diagram
from ..workspace import saved
from . import pdf

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Content types that hold a page.
PAGE_TYPES = ("text/html", "application/xhtml+xml", "text/plain")


def files(spark: SparkSession, path: str, suffix: str, *, recursive: bool = True) -> DataFrame:
    """(path, content) of the files below a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _paragraph(p: ElementTree.Element) -> str:
    said = []
    for node in p.iter():
        if node.tag == f"{_W}t":
            said.append(node.text or "")
        elif node.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr"):
            said.append(" ")
    return " ".join("".join(said).split())


def docx_parts(content: bytes, tables: bool = True) -> tuple[list[str], list[str]] | None:
    """The body's paragraphs and its tables' rows (cells joined by bars); None for what is no such file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    if body is None:
        return None
    paragraphs = [s for p in body.findall(f"{_W}p") if (s := _paragraph(p))]
    rows = []
    for table in body.findall(f"{_W}tbl") if tables else []:
        for row in table.findall(f"{_W}tr"):
            cells = [s for c in row.findall(f"{_W}tc") if (s := " ".join(" ".join(map(_paragraph, c.findall(f"{_W}p"))).split()))]
            if cells:
                rows.append(" | ".join(cells))
    return paragraphs, rows


def docx_documents(found: DataFrame, config: SourceConfig | None = None) -> DataFrame:
    """Document rows of (path, content): one per file, or one for its paragraphs and one for its tables."""
    config = config or SourceConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, kinds, texts = [], [], []
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                both = docx_parts(content.as_py(), config.join_tables)
                if both is None:
                    continue
                made = [("text", [*both[0], *both[1]])] if config.per_file_document else [("text_paragraphs", both[0]), ("text_tables", both[1])]
                for kind, some in made:
                    if len(said := " ".join(some)) >= config.min_text_len:
                        paths.append(path)
                        kinds.append(kind)
                        texts.append(said)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["source", "chunk_kind", "text"])

    rows = found.mapInArrow(run, "source string, chunk_kind string, text string")
    return described(rows, config)


def described(rows: DataFrame, config: SourceConfig, page: str | None = None) -> DataFrame:
    """File rows (source, text, chunk_kind) with name, page, type and time."""
    name = file_name(F.col("source"))
    kind = name_type(name) if config.infer_type else F.lit("unknown")
    number = F.lit(1) if page is None else F.col(page).cast("int")
    return rows.withColumns({"file_name": name, "page_number": number, "doc_type": kind, "created_at": now_iso()})


#: Takes a file's bytes, gives a dict for each page: text, has_images, and if there are such diagram (a summary), image,
#: drawings (type, box or None, points or None) and blocks (x0, y0, x1, y1, text). Raises an exception if it can't read it.
PageReader = Callable[[bytes], list[dict]]
Ocr = Callable[[bytes], str]


def pdf_reader() -> PageReader:
    """The reader on the standard library."""
    return pdf.reader


def rendering_reader() -> PageReader | None:
    """A reader on PyMuPDF, if it is installed: it renders pages for OCR, and gives no geometry."""
    try:
        import fitz
    except ImportError:
        return None

    def read(content: bytes) -> list[dict]:
        with fitz.open(stream=content, filetype="pdf") as pages:
            return [{"text": p.get_text("text"), "has_images": bool(p.get_images()), "image": p.get_pixmap(dpi=200).tobytes()} for p in pages]

    return read


_BOX = pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])
_DRAWINGS = pa.list_(pa.struct([("ord", pa.int64()), ("type", pa.string()), ("bbox", _BOX), ("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]))
_BLOCKS = pa.list_(pa.struct([("ord", pa.int64()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1")), ("text", pa.string())]))
_PAGES = [("source", pa.string()), ("page_number", pa.int32()), ("text", pa.string()), ("has_images", pa.bool_()), ("erd_summary", pa.string()), ("ocr_text", pa.string()), ("drawings", _DRAWINGS), ("blocks", _BLOCKS), ("error", pa.string())]
_PAGE_SCHEMA = "source string, page_number int, text string, has_images boolean, erd_summary string, ocr_text string, drawings array<struct<ord: long, type: string, bbox: struct<x0: double, y0: double, x1: double, y1: double>, points: array<struct<x: double, y: double>>>>, blocks array<struct<ord: long, x0: double, y0: double, x1: double, y1: double, text: string>>, error string"


def _page_row(path: str, n: int, page: dict, ocr: Ocr | None, config: SourceConfig) -> tuple:
    short = len(" ".join((page.get("text") or "").split())) < config.min_text_len
    image = page.get("image") if config.enable_ocr and ocr and short and page.get("has_images") else None
    drawings = [{"ord": k, "type": t, "bbox": box and dict(zip(("x0", "y0", "x1", "y1"), box)), "points": points and [{"x": x, "y": y} for x, y in points]} for k, (t, box, points) in enumerate(page.get("drawings") or [], 1)]
    blocks = [{"ord": k, **dict(zip(("x0", "y0", "x1", "y1", "text"), block))} for k, block in enumerate(page.get("blocks") or [], 1)]
    return (path, n, page.get("text"), bool(page.get("has_images")), page.get("diagram"), ocr(image) if image is not None else None, drawings, blocks, None)


def pdf_pages(found: DataFrame, reader: PageReader, *, ocr: Ocr | None = None, max_pages: int | None = None, config: SourceConfig | None = None) -> DataFrame:
    """Rows of the pages of files (path, content): text, images, geometry, and OCR of pages that have images but too little
    text. A file that its reader can't read is a row with an error."""
    config = config or SourceConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                try:
                    rows = [_page_row(path, n, page, ocr, config) for n, page in enumerate(reader(content.as_py())[: max_pages or None], 1)]
                except Exception as e:
                    rows = [(path, 0, None, False, None, None, [], [], f"{type(e).__name__}: {e}")]
                columns = list(zip(*rows)) or [()] * len(_PAGES)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, _PAGES)], [name for name, _ in _PAGES])

    return found.mapInArrow(run, _PAGE_SCHEMA)


def page_documents(pages: DataFrame, config: SourceConfig | None = None) -> DataFrame:
    """Document rows of pages: their text, what OCR read, and the diagrams that their geometry makes. Pages should be
    written, as they are read several times."""
    config = config or SourceConfig()
    pages = pages.where("error is null")
    if config.parse_diagrams:
        # A page without boxes has no node, and so no diagram: its texts need not be dealt out.
        drawn = pages.where(F.exists("drawings", lambda d: d["bbox"].isNotNull())).select("source", "page_number", "drawings", "blocks")
        at = drawn.withColumn("page_key", F.concat_ws("#", "source", "page_number")).withColumn("file_name", file_name(F.col("source")))
        each = lambda c: at.select("page_key", F.explode(c).alias("x")).select("page_key", "x.*")
        found = diagram.summaries(each("drawings"), each("blocks"), at.select("page_key", "file_name", "page_number"))
        have = pages.withColumn("page_key", F.when(F.exists("drawings", lambda d: d["bbox"].isNotNull()), F.concat_ws("#", "source", "page_number")))
        plain, have = have.where("page_key is null").drop("page_key"), have.where("page_key is not null")
        have = have.join(found, "page_key", "left").withColumn("erd_summary", F.coalesce("erd_summary", "summary")).drop("page_key", "summary")
        pages = plain.unionByName(have)
    return described(page_kinds(pages.drop("drawings", "blocks", "error"), config), config, "page_number")


def pdf_documents(found: DataFrame, reader: PageReader, *, ocr: Ocr | None = None, max_pages: int | None = None, config: SourceConfig | None = None) -> DataFrame:
    """Document rows of (path, content). Files that can't be read give none; ``pdf_pages`` says which."""
    return page_documents(saved(pdf_pages(found, reader, ocr=ocr, max_pages=max_pages, config=config), "pages"), config)


def page_kinds(pages: DataFrame, config: SourceConfig | None = None) -> DataFrame:
    """A row for each page and kind: text if long enough, the diagram's summary if long enough, and what OCR read of a
    page with images whose text is too short."""
    config = config or SourceConfig()
    kept = [c for c in pages.columns if c not in ("text", "has_images", "erd_summary", "ocr_text")]
    text, ocr = normalize_text(F.col("text")), normalize_text(F.col("ocr_text"))
    enough = lambda c: F.length(c) >= config.min_text_len
    item = lambda kind, said, ok: F.when(ok, F.struct(F.lit(kind).alias("chunk_kind"), said.alias("text")))
    found = [item("text", text, enough(text))]
    if config.parse_diagrams:
        found.append(item("erd", F.col("erd_summary"), enough(F.coalesce("erd_summary", F.lit("")))))
    if config.enable_ocr:
        found.append(item("ocr", ocr, F.col("has_images") & ~enough(text) & enough(ocr)))
    return pages.select(*kept, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select(*kept, "x.*")


def web_documents(pages: DataFrame, config: SourceConfig | None = None, *, url: str = "url", html: str = "html", content_type: str | None = None, allowed: Column | None = None, main: MainText | None = None) -> DataFrame:
    """Document rows of fetched pages: of a page type, allowed by robots, and with enough text. ``main`` is tried first on
    each page; without it, or where it finds nothing, the text is what is left when navigation and the like is dropped."""
    config = config or SourceConfig()
    at = pages
    if content_type is not None:
        said = F.lower(F.coalesce(F.col(content_type), F.lit("")))
        ok = said.contains(PAGE_TYPES[0])
        for kind in PAGE_TYPES[1:]:
            ok |= said.contains(kind)
        at = at.where(ok)
    if allowed is not None and config.obey_robots:
        at = at.where(allowed)
    where = normalize_url(F.col(url))
    rows = with_text_and_title(at.select(where.alias("source"), F.col(html).alias("html")), "html", drop_tables=config.strip_tables, main=main)
    return web_rows(rows, config)


def web_rows(rows: DataFrame, config: SourceConfig | None = None) -> DataFrame:
    """Document rows of pages (source, title, text) with enough text."""
    config = config or SourceConfig()
    kind = url_type(parts(F.col("source"))["path"]) if config.infer_type else F.lit("web")
    rows = rows.where(F.length("text") >= config.web_min_text_len)
    return rows.select("source", F.col("source").alias("file_name"), F.lit(1).alias("page_number"), kind.alias("doc_type"), F.lit("text").alias("chunk_kind"), now_iso().alias("created_at"), "title", "text")


@functools.lru_cache(1000)
def _robots(text: str):
    """A robots file's rules; parsed once in a worker."""
    from urllib.robotparser import RobotFileParser

    reader = RobotFileParser()
    reader.parse(text.splitlines())
    return reader


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """The columns and ``robots_ok``, by the robots files (place, robots) of the urls' places; a missing file allows all."""
    place = parts(normalize_url(F.col(url)))["place"]

    @F.udf("boolean", useArrow=True)
    def ok(text, address):
        return text is None or _robots(text).can_fetch(agent, address)

    known = rules.select(F.lower("place").alias("place_"), "robots")
    return urls.join(known, place == F.col("place_"), "left").withColumn("robots_ok", ok("robots", normalize_url(F.col(url)))).drop("place_", "robots")


def fetch(urls: DataFrame, get: Callable[[], Callable[[str], tuple[str, str, str]]], url: str = "url") -> DataFrame:
    """(url, final_url, content_type, html) of live pages: ``get`` makes one client for each stream of batches; a page
    that it can't get is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = get()
        for batch in batches:
            rows = []
            for address in batch["url"].to_pylist():
                try:
                    rows.append((address, *client(address)))
                except Exception:
                    rows.append((address, address, "", ""))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 4, ["url", "final_url", "content_type", "html"])

    return urls.select(F.col(url).alias("url")).mapInArrow(run, "url string, final_url string, content_type string, html string")


def page_client(config: SourceConfig | None = None) -> Callable[[], Callable[[str], tuple[str, str, str]]]:
    """Makes clients for ``fetch`` on the standard library: redirects are followed, requests are spaced out."""
    config = config or SourceConfig()

    def make():
        import time
        import urllib.request

        def get(address: str) -> tuple[str, str, str]:
            time.sleep(config.sleep_seconds)
            asked = urllib.request.Request(address, headers={"User-Agent": config.user_agent})
            with urllib.request.urlopen(asked, timeout=config.timeout) as r:
                charset = r.headers.get_content_charset() or "utf-8"
                return r.geturl(), r.headers.get("Content-Type", ""), r.read().decode(charset, errors="replace")

        return get

    return make


def live_pages(client, config: SourceConfig | None = None, url: str = "url") -> Callable[[DataFrame], DataFrame]:
    """Makes (url, html) of live pages of urls: each place's robots file is fetched first, then the pages that it allows
    and that are of a page type."""
    config = config or SourceConfig()

    def get(urls: DataFrame) -> DataFrame:
        at = urls.select(normalize_url(F.col(url)).alias("url"))
        if config.obey_robots:
            p = parts(F.col("url"))
            places = at.select(F.concat(p["scheme"], F.lit("://"), p["place"], F.lit("/robots.txt")).alias("url")).distinct()
            rules = fetch(places, client).where("html != ''").select(parts(F.col("url"))["place"].alias("place"), F.col("html").alias("robots"))
            at = robots_allowed(at, rules).where("robots_ok").select("url")
        said = F.lower("content_type")
        return fetch(at, client).where("html != ''").where(reduce(lambda a, b: a | b, [said.contains(x) for x in PAGE_TYPES]))

    return get


def fetched_documents(urls: DataFrame, client, config: SourceConfig | None = None, url: str = "url") -> DataFrame:
    """Document rows of live pages, as far as robots files allow."""
    config = config or SourceConfig()
    pages = live_pages(client, config, url)(urls)
    return web_documents(pages.select(F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url")).alias("url"), "html"), config)


def ocr_program(name: str = "tesseract") -> Ocr | None:
    """OCR by a program that reads an image from its input, if it is installed."""
    import shutil
    import subprocess

    path = shutil.which(name)
    if path is None:
        return None
    return lambda image: subprocess.run([path, "-", "-"], input=image, capture_output=True, timeout=300, check=False).stdout.decode(errors="replace")
