"""HTML extraction by tree scoring: paragraphs pass points for length and commas to their ancestors, discounted by
link density; the best container and its good siblings are kept. Each container passes half of its points on. Where the
best one is only a part, what it is a part of is kept instead: the article or main element around it, else the container
that is named as content, else whatever holds the table, list, quotation or section.

What goes as boilerplate: the elements of ``DROPPED``, hidden ones, those whose role says so, and those whose class or id
has one of the words of ``UNLIKELY`` and none that speaks for content; of a paragraph, heading, item or cell the whole
name must be made of such words. The header of an article is one of the headers that go. A form that holds half of the
page's text or more is no form but a frame, and stays; so does the text of inline elements. Siblings of the best container
stay if they score well, are named as content, or are paragraphs, lists, tables and the like that say something without
links; beside an article or main element only those that score well, paragraphs and titles do.

The time is in proportion to the page, however deep its tags are nested and whatever is left unclosed in it.

Defined cases: null or empty html, and pages of nothing but boilerplate, give an empty text; pages without paragraphs
are scored by the text that stands directly in their containers; equal scores go to the container that opens first;
unclosed and stray tags are tolerated, and a quote that is never closed is an ordinary character; nothing is capped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as co

# Elements by their role.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template textarea title iframe noembed noframes xmp nav footer header aside form button select fieldset dialog menu svg canvas audio video object map head datalist".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body center details div dl html main ol section table tbody td th tr ul blockquote figure dd li".split())
PARAGRAPH = frozenset("p pre blockquote td dd li h1 h2 h3 h4 h5 h6 figcaption dt".split())
#: Never a page's whole content where something around them is no boilerplate; a section's document may be the body.
PART = frozenset("td th tr tbody table center li ul ol dl dd blockquote figure details section".split())
#: What may stand beside a page's content and belong to it.
BESIDE = frozenset("ul ol dl table blockquote figure pre".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("html body caption tbody td tfoot th thead tr".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body table ul ol dl article section main div td th nav aside header footer form blockquote".split())
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|combx|comments?|commentlist|respond|replies|cookies?|consent|gdpr|notice|disclaimer|disqus|footer|footnav|header|masthead|menu|modal|nav|navbar|navigation|newsletter|outbrain|overlay|pager|pagination|popup|promo\w*|related|remark|rss|share|sharing|shoutbox|sidebar|skyscraper|social|sponsor\w*|subscribe|taboola|toolbar|widget)(?:$|[\s_-])", re.I
)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|text|blog|story)(?:$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|entry|hentry|post|story)(?:$|[\s_-])", re.I)

#: Said again to the end of a name: nothing but such words.
ONLY_UNLIKELY = re.compile(rf"(?:{UNLIKELY.pattern.removeprefix(r'(?:^|[\s_-])').removesuffix(r'(?:$|[\s_-])')}(?:[_-]|$))+", re.I)

#: A tag without quotes, or with whole ones; none of its parts gives back what it took.
_TAG = re.compile(r"<(/)?([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_NAME = re.compile(r"<(/)?([a-zA-Z][^\s/>]*+)", re.S)
_PLAIN = re.compile(r"[^>\"']*+", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
#: Points of a paragraph for its length: one for each hundred characters, three at most.
CHARS_PER_POINT, LENGTH_POINTS = 100, 3
#: A sibling needs this share of the best score.
SIBLING_SHARE = 0.2
#: What is linked to this share is no content.
MOSTLY_LINKS = 0.5


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "dropped", "apart", "score", "given", "reached", "order", "chars", "linked")

    def __init__(self, tag: str, attrs: dict[str, str], parent, order: int) -> None:
        self.tag, self.attrs, self.parent, self.order = tag, attrs, parent, order
        self.children: list = []
        self.apart = tag in DROPPED or _hidden(tag, attrs)
        self.dropped = parent is not None and parent.dropped or self.apart
        self.score = self.given = 0.0
        self.reached = False
        self.chars = self.linked = 0


def _hidden(tag: str, attrs: dict[str, str]) -> bool:
    if tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if attrs.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alertdialog", "alert"):
        return True
    names = [x for x in f"{attrs.get('class', '')} {attrs.get('id', '')}".split() if not x.lower().startswith(("has-", "with-", "no-"))]
    bad = [x for x in names if (ONLY_UNLIKELY.fullmatch(x) if tag in PARAGRAPH else UNLIKELY.search(x))]
    return bool(bad) and not any(LIKELY.search(x) for x in names if x not in bad)


class _Stack:
    """The open elements, and where those of each name, and the scopes, stand among them."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places, self.scopes = [root], {"html": [0]}, [0]

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in SCOPE:
            self.scopes.append(at)

    def cut(self, at: int) -> None:
        """Close the element at this place, and all inside it."""
        while len(self.nodes) > at:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()

    def last(self, name: str) -> int:
        """The place of the innermost element of the name, or 0, where the root stands."""
        found = self.places.get(name)
        return found[-1] if found else 0

    def close(self, names: tuple[str, ...]) -> None:
        """Close the innermost element of these names that no scope lies inside of."""
        at = max(map(self.last, names))
        if at and at >= self.scopes[-1]:
            self.cut(at)


class _Tags:
    """Finds tags in a page, from left to right. What was searched for in vain isn't searched for again."""

    def __init__(self, page: str) -> None:
        self.page, self.missing, self.failed, self.careful = page, set(), set(), False

    def find(self, what: str, at: int) -> int:
        """Where it stands next, or -1; places that are asked for never fall by much."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag(self, at: int) -> tuple[str, str, str, int] | None:
        """Of the tag that starts here the slash, name, and rest, and where it ends; None if there is none."""
        if not self.careful:
            if m := _TAG.match(self.page, at):
                return m[1], m[2], m[3], m.end()
            self.careful = True
        m = _NAME.match(self.page, at)
        if not m:
            return None
        end = self._end(m.end())
        if end < 0:  # no whole tag with its quotes: it ends at once
            end = self.find(">", m.end())
        return None if end < 0 else (m[1], m[2], self.page[m.end() : end], end + 1)

    def _end(self, at: int) -> int:
        """Where the tag ends, past whole quotes; -1 if it doesn't."""
        passed = []
        while at not in self.failed:
            passed.append(at)
            at = _PLAIN.match(self.page, at).end()
            if at == len(self.page):
                break
            if self.page[at] == ">":
                return at
            close = self.find(self.page[at], at + 1)
            if close < 0:
                break
            at = close + 1
        self.failed.update(passed)
        return -1


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in page order."""
    root = Node("html", {}, None, 0)
    nodes, stack, tags = [root], _Stack(root), _Tags(page)
    at = said = 0  # what stands from ``said`` to ``at`` is text

    def tell(end: int) -> None:
        if end > said:
            stack.nodes[-1].children.append(entities.unescape(page[said:end]))

    while (at := tags.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", at):
                end = tags.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
            else:
                end = tags.find(">", at) + 1
            if end:
                tell(at)
                at = said = end
            else:
                at += 1
            continue
        found = tags.tag(at) if after == "/" or after.isascii() and after.isalpha() else None
        if found is None:
            at += 1
            continue
        tell(at)
        slash, name, rest, at = found
        said, name = at, name.lower()
        if slash:
            place = stack.last(name)
            if place and (name in BLOCK or place >= stack.scopes[-1]):  # a stray inline end tag never closes a container
                stack.cut(place)
            continue
        attrs = {a[0].lower(): entities.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}
        if name == "html" or name == "body" and stack.last("body"):
            root.attrs.update(attrs) if name == "html" else None
            continue
        if name in CLOSES_P:
            stack.close(("p",))
        if name in SAME_CLOSES:
            stack.close(SAME_CLOSES[name])
        if name in HEADING and stack.nodes[-1].tag in HEADING:
            stack.cut(len(stack.nodes) - 1)
        node = Node(name, attrs, stack.nodes[-1], len(nodes))
        stack.nodes[-1].children.append(node)
        nodes.append(node)
        if name in RAW:
            m = _RAW_END[name].search(page, at)
            at = said = m.end() if m else len(page)
        elif name not in VOID and not rest.endswith("/") or name in BLOCK and name != "hr":
            stack.push(node)
    tell(len(page))
    return root, nodes


def _unwrap(nodes: list[Node]) -> None:
    """Forms that hold half of the page's text or more don't count as such."""
    forms = [node for node in nodes if node.tag == "form" and node.apart and not _hidden(node.tag, node.attrs)]
    if not forms:
        return
    size = [0] * len(nodes)
    for node in reversed(nodes):
        size[node.order] += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        if node.parent is not None and (node.tag == "form" or not node.apart):
            size[node.parent.order] += size[node.order]
    for node in forms:
        node.apart = 2 * size[node.order] < size[0]
    for node in nodes:
        node.dropped = node.parent is not None and node.parent.dropped or node.apart


def _measure(nodes: list[Node]) -> None:
    """Characters, and characters inside links, below each node that is kept."""
    for node in reversed(nodes):
        if node.dropped:
            continue
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(" ".join(child.split()))
            elif not child.dropped:
                node.chars += child.chars
                node.linked += child.linked
        if node.tag == "a":
            node.linked = node.chars


def _own(node: Node) -> str:
    """The text of a block without that of blocks inside it."""
    parts, todo = [], [iter(node.children)]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
        elif isinstance(child, str):
            parts.append(child)
        elif not child.dropped and child.tag not in BLOCK:
            parts.append(" ") if child.tag == "br" else todo.append(iter(child.children))
    return " ".join("".join(parts).split())


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _named(node: Node) -> str:
    return f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"


def _whole(best: Node) -> Node:
    """The node that the best one is a part of, or itself. Around a part, link lists beside its branch are dropped."""
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    fit = [x for x in path if density(x) < MOSTLY_LINKS]
    for tag in ("article", "main"):
        if around := [x for x in fit if x.tag == tag]:
            return around[-1]
    if CONTENT.search(_named(best)) and best.tag not in PART:
        return best
    if around := [x for x in fit if CONTENT.search(_named(x)) and x.tag not in PART and x.tag not in ("html", "body")]:
        return around[0]
    at = best
    for up in path[1:]:
        if at.tag not in PART or density(up) >= MOSTLY_LINKS or at.tag == "section" and up.tag in ("html", "body"):
            break
        for child in up.children:
            if isinstance(child, Node) and child is not at and child.tag in CONTAINER and density(child) >= MOSTLY_LINKS:
                child.dropped = True
        at = up
    return at


def main_nodes(nodes: list[Node]) -> list[Node]:
    """The best container and the siblings that go with it, in page order."""
    _unwrap(nodes)
    _measure(nodes)
    for node in reversed(nodes):  # each node after all inside it
        if node.dropped:
            continue
        points = 0.0
        if node.tag in PARAGRAPH or node.tag in CONTAINER:
            if said := _own(node):
                points = 1 + said.count(",") + min(len(said) / CHARS_PER_POINT, LENGTH_POINTS)
                points *= 1 - density(node)
                node.reached |= node.tag not in PARAGRAPH
        up = node.parent
        if node.tag in CONTAINER:
            node.score = node.given + points * (node.tag not in PARAGRAPH)
            passed = node.score / 2
        else:
            passed = node.given
        if up is not None:
            up.given += passed + points * (node.tag in PARAGRAPH)
            up.reached |= node.reached or points > 0 or node.tag in PARAGRAPH and bool(said)
    scored = [node.order for node in nodes if node.reached and node.tag in CONTAINER and not node.dropped]
    if not scored:
        return []
    for k in scored:
        node = nodes[k]
        node.score += 25 * bool(LIKELY.search(_named(node))) + 5 * (node.tag in ("article", "main"))
        node.score *= 1 - density(node)
    best = _whole(max((nodes[k] for k in scored), key=lambda x: (x.score, -x.order)))
    if best.parent is None:
        return [best]
    out = []
    for node in best.parent.children:
        if node is best:
            out.append(node)
        elif isinstance(node, Node) and not node.dropped and node.tag in BLOCK and node.chars:
            good = node.tag in CONTAINER and node.score >= max(10, SIBLING_SHARE * best.score) and density(node) < 0.25
            good |= node.tag == "p" and (node.chars > 80 and density(node) < 0.25 or bool(re.search(r"[.!?](?:\s|$)", _own(node))) and not node.linked)
            if best.tag not in ("article", "main"):
                good |= node.tag in CONTAINER and bool(CONTENT.search(_named(node))) and density(node) < 0.25
                good |= node.tag in BESIDE and not node.linked and (node.chars > 80 or bool(re.search(r"[.!?](?:\s|$)", _own(node))) or node.order > best.order)
            good |= node.tag in ("h1", "h2") and node.order < best.order and not node.linked
            if good:
                out.append(node)
    return out


def blocks(tops: list[Node]) -> list[str]:
    """The texts of all blocks below the nodes, in page order."""
    out: list[str] = []
    parts: list[str] = []

    def end() -> None:
        if said := " ".join("".join(parts).split()):
            out.append(said)
        parts.clear()

    for top in tops:
        end()
        todo = [(top, iter(top.children))]
        while todo:
            node, rest = todo[-1]
            child = next(rest, None)
            if child is None:
                todo.pop()
                if node.tag in BLOCK:
                    end()
            elif isinstance(child, str):
                parts.append(child)
            elif child.tag == "br":
                parts.append(" ")
            elif not child.dropped:
                if child.tag in BLOCK:
                    end()
                todo.append((child, iter(child.children)))
        end()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by blank lines."""
    if not page:
        return ""
    _, nodes = parse(page)
    return "\n\n".join(blocks(main_nodes(nodes)))


def extract(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text: str = "text") -> DataFrame:
    """``keep``, the main text of each page, and its length in code points."""
    names = [f"c{i}" for i in range(len(keep))]
    source = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{html}`").alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in co.slices(batches, "page"):
            texts = [main_text(x) for x in batch["page"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*names, "t", "n"])

    schema = ", ".join([*(f"{n} {source.schema[n].dataType.simpleString()}" for n in names), "t string, n long"])
    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], F.col("t").alias(text), F.col("n").alias("n_chars"))
