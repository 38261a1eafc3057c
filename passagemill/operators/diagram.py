"""Diagrams from page geometry: boxes with labels are nodes, lines whose ends lie near boxes are edges.

``drawings``: page_key, ord, type, bbox (x0, y0, x1, y1), points (array of x, y). ``blocks``: page_key, ord, x0, y0, x1,
y1, text. Joins are by page and grid cell (``spatial``); nearest neighbours are minima per box or point, ties to the lower
``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from . import spatial

PAD, LABEL_DIST, EDGE_LABEL_DIST, SNAP_DIST = 1.5, 36.0, 48.0, 64.0
TITLE_BLOCKS, MIN_LABEL, MAX_EDGE_LABEL = 6, 2, 200


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with normalised texts and centres, without empty ones."""
    said = blocks.withColumn("text", normalize_text(F.col("text"))).where("text != ''")
    return said.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})


def boxes(drawings: DataFrame) -> DataFrame:
    """(page_key, ord, x0, y0, x1, y1) of what is a rectangle, or has one."""
    return drawings.where("bbox is not null").select("page_key", "ord", "bbox.*")


def lines(drawings: DataFrame) -> DataFrame:
    """(page_key, ord, px, py, qx, qy): ends of lines and curves of two points or more that have no rectangle."""
    at = drawings.where("bbox is null and type in ('line', 'curve') and size(points) >= 2")
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    return at.select("page_key", "ord", first["x"].alias("px"), first["y"].alias("py"), last["x"].alias("qx"), last["y"].alias("qy"))


def nodes(drawings: DataFrame, blocks: DataFrame, *, label_dist: float = LABEL_DIST, min_label: int = MIN_LABEL) -> DataFrame:
    """(page_key, ord, id, cx, cy): boxes with the first word of their longest text inside, or else of the nearest."""
    said, rects = text_blocks(blocks), boxes(drawings)
    b = said.select("page_key", F.col("ord").alias("o_"), "text", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"))
    whole = (F.col("x") >= F.col("x0") - PAD) & (F.col("y") >= F.col("y0") - PAD) & (F.col("bx1") <= F.col("x1") + PAD) & (F.col("by1") <= F.col("y1") + PAD)
    longest = spatial.inside(rects, b, PAD).where(whole).groupBy("page_key", "ord").agg(F.max_by("text", F.struct(F.length("text"), -F.col("o_"))).alias("inner"))
    centres = rects.select("page_key", "ord", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    near = spatial.nearest(centres, said, label_dist, "text", "near")
    at = centres.join(longest, ["page_key", "ord"], "left").join(near, ["page_key", "ord"], "left")
    label = F.element_at(F.split(F.coalesce("inner", "near"), " "), 1)
    return at.select("page_key", "ord", label.alias("id"), F.col("x").alias("cx"), F.col("y").alias("cy")).where(F.length("id") >= min_label)


def edges(drawings: DataFrame, blocks: DataFrame, *, snap_dist: float = SNAP_DIST, label_dist: float = EDGE_LABEL_DIST) -> DataFrame:
    """(page_key, ord, from, to, label): lines whose ends snap to different nodes."""
    found, ends = nodes(drawings, blocks), lines(drawings)
    sides = [spatial.nearest(ends.select("page_key", "ord", F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")), found, snap_dist, "id", name) for p, name in (("p", "from"), ("q", "to"))]
    middle = ends.select("page_key", "ord", ((F.col("px") + F.col("qx")) / 2).alias("x"), ((F.col("py") + F.col("qy")) / 2).alias("y"))
    label = spatial.nearest(middle, text_blocks(blocks), label_dist, "text", "label")
    at = sides[0].join(sides[1], ["page_key", "ord"]).where(F.col("from") != F.col("to")).join(label, ["page_key", "ord"], "left")
    return at.withColumn("label", F.when(F.length("label") < MAX_EDGE_LABEL, F.col("label")))


def titles(blocks: DataFrame, scan: int = TITLE_BLOCKS) -> DataFrame:
    """(page_key, title): of the topmost blocks, the first of 3 to 80 characters."""
    place = F.row_number().over(Window.partitionBy("page_key").orderBy("y0", "ord"))
    top = text_blocks(blocks).withColumn("place", place).where(F.col("place") <= scan).where(F.length("text").between(3, 80))
    return top.groupBy("page_key").agg(F.min_by("text", "place").alias("title"))


def summaries(drawings: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_key, summary) of pages (page_key, file_name, page_number) that have a node."""
    listed = lambda rows, said, name: rows.groupBy("page_key").agg(F.collect_list(F.struct("ord", said.alias("said"))).alias("l")).select("page_key", F.transform(F.array_sort("l"), lambda x: x["said"]).alias(name))
    boxes_ = listed(nodes(drawings, blocks), F.col("id"), "n")
    arrow = F.concat(F.col("from"), F.lit(" -> "), F.col("to"), F.coalesce(F.concat(F.lit(" ("), F.col("label"), F.lit(")")), F.lit("")))
    arrows = listed(edges(drawings, blocks), arrow, "e")
    at = boxes_.join(pages, "page_key").join(arrows, "page_key", "left").join(titles(blocks), "page_key", "left")
    # The labels of a summary.
    text = F.concat(
        F.lit("--- DOCUMENT CHUNK (ERD) ---\nSOURCE: "), "file_name", F.lit(" (Page "), F.col("page_number").cast("string"), F.lit(")\nCATEGORY: erd\nTITLE: "), F.coalesce("title", F.lit("")),
        F.lit("\nNODES: "), F.array_join("n", ", "), F.lit("\nEDGES: "), F.coalesce(F.array_join("e", "; "), F.lit("")),
    )
    return at.select("page_key", text.alias("summary"))


def diagram_json(drawings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_key, diagram): title, nodes and edges of pages with a node, as a struct."""
    n = nodes(drawings, blocks).groupBy("page_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: F.struct(x["id"].alias("id"))).alias("nodes"))
    e = edges(drawings, blocks).groupBy("page_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "from", "to", "label"))), lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), x["label"].alias("label"))).alias("edges"))
    at = n.join(e, "page_key", "left").join(titles(blocks), "page_key", "left")
    none = F.expr("cast(array() as array<struct<from: string, to: string, label: string>>)")
    return at.select("page_key", F.struct(F.coalesce("title", F.lit("")).alias("title"), "nodes", F.coalesce("edges", none).alias("edges")).alias("diagram"))
