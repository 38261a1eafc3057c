import html
import re
import time

import pytest

from passagemill.llm import html_text as ht

LONG = "This is a paragraph, with commas, and enough text to count as the content of an article, or so one hopes."


def test_fixtures(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        text = "\n\n".join(x for x in parts if x)
        want[r["page_id"]] = (r["url"], text, len(text))
    assert {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in ht.extract(pages).collect()} == want


def test_boilerplate_goes_and_siblings_stay():
    page = f"""<html><head><title>T</title><meta charset=x></head><body class="page"><div id="header"><p>{LONG}</p></div>
    <div class="main-menu"><ul><li><a href=/>{LONG}</a></ul></div><div class="cookie-notice"><p>{LONG}</p></div>
    <div class="content"><h1>Head &amp; line</h1><p>One,&nbsp;{LONG}<script>if (a</p>b) x()</script><p>Two <b>bold</b>,<br>{LONG}</div>
    <aside><p>{LONG}</p></aside><form><p>{LONG}</p></form><div class="comments"><p>{LONG}, {LONG}</p></div><footer><p>{LONG}</p></footer><!-- <p>{LONG}</p>"""
    assert ht.main_text(page) == f"Head & line\n\nOne, {LONG}\n\nTwo bold, {LONG}"


def test_names_of_elements():
    page = f'<div class="content with-sidebar"><p>{LONG}</p></div><div class="sidebar-content"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>'
    assert ht.main_text(page) == LONG


def test_link_density_and_sections():
    links = "".join(f"<p><a href=/{i}>{LONG}</a></p>" for i in range(9))
    page = f"<body><div>{links}</div><section><p>{LONG}</p><p>{LONG}</p></section>"
    assert ht.main_text(page) == f"{LONG}\n\n{LONG}"


def test_odd_pages(spark):
    deep = "<div>" * 3000 + f"<p>{LONG}" + "</div>" * 3000
    cases = {1: None, 2: "", 3: "plain &lt;text&gt;\n only", 4: "<p>unclosed <b>bold<p>next", 5: "<script>var a = '<p>no</p>'", 6: deep, 7: "<ul><li>a<li>b</ul>", 8: "<table><tr><td>x<td>y</table>", 9: "<p title='a>b'>q</p>", 10: "< <> </ </p> <p", 11: "<div hidden><p>no</p></div><p>yes"}
    pages = spark.createDataFrame([(k, "u", v, "t", 1) for k, v in cases.items()], "page_id long, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r["text"] for r in ht.extract(pages).collect()}
    assert got == {1: "", 2: "", 3: "plain <text> only", 4: "unclosed bold\n\nnext", 5: "", 6: LONG, 7: "a\n\nb", 8: "x\n\ny", 9: "q", 10: got[10], 11: "yes"}
    assert ht.extract(pages.limit(0)).collect() == []


CELL = "A cell of a table, with commas, that goes on, and on, and on, until it is as long as a paragraph of the article itself. " * 2
PARTS = {
    "long cells": "<table><tbody>" + f"<tr><td>{CELL}<td>{CELL}" * 30 + "</table>",
    "numbers": "<table>" + "<tr>" + "<td>3,14" * 600 + "</table>",
    "list": "<ul>" + f"<li>{CELL}" * 60 + "</ul>",
    "nested lists": "<ol>" + f"<li>{CELL}<ul><li>{CELL}<li>{CELL}</ul>" * 20 + "</ol>",
    "terms": "<dl>" + f"<dt>word<dd>{CELL}" * 60 + "</dl>",
    "quotation": "<blockquote>" + f"<p>{CELL}</p>" * 40 + "</blockquote>",
    "sections": "<section>" + f"<p>{CELL}</p>" * 40 + "</section><section><p>Short one</section>",
    "divisions": "<div>" + f"<p>{CELL}</p>" * 40 + "</div><div><p>Short one</div>",
}


@pytest.mark.parametrize("around", ["article", "main", 'div class="entry-content"'])
@pytest.mark.parametrize("part", PARTS)
def test_parts_do_not_replace_the_article(around, part):
    """Every word of the content stays, once and in order; nothing beside it comes in."""
    inner = f"<h1>Head</h1><p>{LONG}</p>{PARTS[part]}<h2>More</h2><p>Last</p>"
    page = f"<body><nav><a href=/>{LONG}</a></nav><div><a href=/x>{LONG}</a></div><{around}>{inner}</{around.split()[0]}><div><p>Imprint</div>"
    assert ht.main_text(page).split() == re.sub("<[^>]*>", " ", inner).split()


def test_a_part_without_an_article_keeps_its_whole():
    page = f"<body><table><tr><td><a href=/x>{LONG}</a></td><td><p>{LONG}</p><p>{LONG}</p></td></tr><tr><td>short</td></tr></table>"
    assert ht.main_text(page) == f"{LONG}\n\n{LONG}\n\nshort"
    page = f"<body><div><p>First</p><ul>" + f"<li>{CELL}" * 20 + "</ul><p>last</p></div>"
    assert ht.main_text(page).split() == re.sub("<[^>]*>", " ", page).split()


HARD = {
    "nested": "<div>" * 100_000 + LONG + "</div>" * 100_000,
    "nested, each with text": "".join(f"<div>x{i}" for i in range(100_000)),
    "open inline elements": "<b>" * 100_000 + "<p>x</p>" * 50_000,
    "stray end tags": "<b>" * 50_000 + "</i>" * 50_000,
    "lists in lists": "<ul><li>x" * 50_000,
    "unclosed quotes": '<a href="x>' * 100_001,
    "quotes in quotes": "<p title=\"a'b>t" * 100_001,
    "unclosed declarations": "<!x" * 100_000,
    "attributes": "<a " + "b=\"c' " * 100_000 + ">",
}


@pytest.mark.parametrize("what", HARD)
def test_time_goes_with_length(what):
    began = time.process_time()
    ht.main_text(HARD[what])
    assert time.process_time() - began < 10


def test_unclosed_quotes_and_stray_tags():
    assert ht.main_text(f"<p title=\"x>{LONG}</p><p title='y>z</p>") == f"{LONG}\n\nz"
    assert ht.main_text(f"<body><p>{LONG}</b></i> more <? php x ?> and <!DOCTYPE z>so < on</p>") == f"{LONG} more and so < on"


STORY = "A sentence of the story, with a comma, and some more words to read, goes on here. " * 3


def told(body):
    return ht.main_text(f"<html><body><nav><a href=x>Menu</a></nav>{body}<footer>Footer words.</footer></body></html>").split("\n\n")


def test_nothing_of_an_article_is_lost():
    said = STORY.strip()
    assert told(f'<form id="aspnetForm"><input name=q><div class="content"><p>{STORY}</p><p>{STORY}</p></div></form>') == [said, said]
    assert told(f"<article><p>{STORY}</p><form>Your name <input> <p>Subscribe now.</p></form></article>") == [said]
    assert told(f'<article><p>{STORY}</p><p class="share-price">The share closed at 5 euros.</p><p class="share">Share this.</p></article>') == [said, "The share closed at 5 euros."]
    assert told(f"<article><p>{STORY}</p><p>Set the <label>volume</label> to <math>five</math> now.</p></article>") == [said, "Set the volume to five now."]
    assert told(f'<div class="content"><p>{STORY}</p><p>{STORY}</p></div><div class="content"><p>A short end.</p></div>') == [said, said, "A short end."]
    assert told(f"<div><p>{STORY}</p><p>{STORY}</p></div><ul><li>one thing</li><li>another</li></ul>") == [said, said, "one thing", "another"]
    assert told(f"<div><p>{STORY}</p><p>{STORY}</p></div><ul><li><a href=x>Other page</a></li><li><a href=y>And another</a></li></ul>") == [said, said]
