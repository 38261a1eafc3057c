"""Page text, title and links by the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that hold no content, and what marks an element's class or id as navigation.
DROPPED = frozenset("script style noscript nav footer header aside".split())
MARKED = re.compile("nav|menu|footer|header|cookie", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Text(HTMLParser):
    """Text nodes outside dropped elements; the title; the first h1 that is kept."""

    def __init__(self, drop_tables: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.drop_tables = drop_tables
        self.open: list[tuple[str, bool]] = []  # elements, and whether text in them is dropped
        self.texts: list[str] = []
        self.titles: list[list[str]] = []
        self.heads: list[list[str]] = []
        self.inside: dict[str, int] = {}  # open elements by name

    def handle_starttag(self, tag, attrs) -> None:
        if tag in VOID:
            return
        marks = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        gone = bool(self.open and self.open[-1][1]) or tag in DROPPED or self.drop_tables and tag == "table" or bool(MARKED.search(marks))
        self.open.append((tag, gone))
        self.inside[tag] = self.inside.get(tag, 0) + 1
        if not gone and tag == "title":
            self.titles.append([])
        if not gone and tag == "h1":
            self.heads.append([])

    def handle_endtag(self, tag) -> None:
        while self.inside.get(tag):
            closed = self.open.pop()[0]
            self.inside[closed] -= 1
            if closed == tag:
                return

    def handle_data(self, data) -> None:
        if self.open and self.open[-1][1]:
            return
        self.texts.append(data)
        if self.inside.get("title") and self.titles:
            self.titles[-1].append(data)
        if self.inside.get("h1") and self.heads:
            self.heads[-1].append(data)


def text_and_title(page: str | None, drop_tables: bool = False) -> tuple[str, str]:
    """A page's text, and its title or else its first heading."""
    reader = _Text(drop_tables)
    reader.feed(page or "")
    reader.close()
    title = "".join(reader.titles[0]).strip() if reader.titles else ""
    if not title and reader.heads:
        title = " ".join(" ".join(reader.heads[0]).split())
    return " ".join(" ".join(reader.texts).split()), title


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href" and v is not None][:1]


def links(page: str | None, base: str | None) -> list[str]:
    """Absolute http(s) links in page order, repeats kept, fragments cut."""
    reader = _Links()
    reader.feed(page or "")
    reader.close()
    out = []
    for href in reader.found:
        try:
            target = urldefrag(urljoin(base or "", href.strip()))[0]
        except ValueError:
            continue
        if target.startswith(("http://", "https://")):
            out.append(target)
    return out


#: Takes a page, gives its main text, or a dict with text and title, or nothing.
MainText = Callable[[str], str | dict | None]


def main_text_and_title(page: str | None, main: MainText | None, drop_tables: bool = False) -> tuple[str, str]:
    """Of the main extractor if it finds something, with the page's own title if it names none; else without it."""
    plain = lambda: text_and_title(page, drop_tables)
    if main is None or not page:
        return plain()
    try:
        said = main(page)
    except Exception:  # whatever goes wrong in it, the page still has a text
        return plain()
    text, title = (said.get("text"), said.get("title")) if isinstance(said, dict) else (said, None)
    text = " ".join((text or "").split())
    return (text, title or plain()[1]) if text else plain()


def with_text_and_title(pages: DataFrame, html: str = "html", *, drop_tables: bool = False, main: MainText | None = None) -> DataFrame:
    """The columns, and ``text`` and ``title`` of the page in each row; ``main`` is an extractor to try first."""
    source = pages.withColumn("page_", F.col(html))
    kept = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [main_text_and_title(x, main, drop_tables) for x in batch["page_"].to_pylist()]
            columns = [batch[c] for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t for t, _ in both], pa.string()), pa.array([t for _, t in both], pa.string())], [*kept, "text", "title"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return source.mapInArrow(run, f"{schema}, text string, title string")


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, link): every link of every page in order."""

    @F.udf("array<string>", useArrow=True)
    def found(page, base):
        return links(page, base)

    return pages.select(F.col(key), F.posexplode(found(F.col(html), F.col(url))).alias("pos", "link"))
