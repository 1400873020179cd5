"""The box graph: directed edges between boxes of an image, added and pruned by passes.

Boxes have image_id, x, y, w, h and, where needed, sea (colour group), is_word and
line_id. An edge row holds image_id and both boxes as structs ``src`` and ``dst``.
Every pass is edges to edges and decides on the edges that it is given. Joins are
equi joins on the image (and group) with the geometry as residual, so they hash;
a grid cell is added where the geometry is local and the group may be large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions import geometry as G

BOX = ("x", "y", "w", "h")


def base_distance(height: float, sensitivity: float = 1.0e0) -> float:
    scale = height / 1964
    return sensitivity * 2 * ((8 * scale) ** 2 + (5 * scale) ** 2) ** 0.5e0


def real(value: float) -> str:
    """A double literal for SQL text."""
    return f"{float(value)!r}e0"


def box(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + k).alias(k) for k in BOX))


def prefixed(boxes: DataFrame, p: str, *keys: str) -> DataFrame:
    """Columns renamed with a prefix, but for the join keys."""
    return boxes.select(*(F.col(c).alias(c if c in keys else p + c) for c in boxes.columns))


def flat(edges: DataFrame) -> DataFrame:
    return edges.select("*", *(F.col(f"{s}.{k}").alias(f"{p}{k}") for s, p in (("src", "a_"), ("dst", "b_")) for k in BOX))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("image_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse, from one reading of ``edges``."""
    return edges.select("image_id", F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))


def meeting(a: DataFrame, b: DataFrame, *keys: str, grow_a: str = "0", grow_b: str = "0", cell: int = 128, rows: int | None = None) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` (x, y, w, h and more) of an image (and group) whose boxes, grown on all sides by an
    expression of their own row, touch; columns a_*, b_*, each pair of rows once.

    Boxes meet in grid cells, and a pair counts only in the cell of its common corner: a large image is split over
    tasks, and nothing has to be made distinct afterwards. ``rows`` is a cell's height where boxes are wide and low.
    """
    keys = ("image_id", *keys)

    def dealt(held: DataFrame, p: str, grow: str) -> DataFrame:
        low = [f"cast(floor(({k} - ({grow})) / {c}) as int)" for k, c in (("x", cell), ("y", rows or cell))]
        high = [f"cast(floor(({k} + {n} + ({grow})) / {c}) as int)" for k, n, c in (("x", "w", cell), ("y", "h", rows or cell))]
        out = held.select("*", F.expr(f"posexplode(sequence({low[0]}, {high[0]}))").alias("px", "cx"))
        out = out.select("*", F.expr(f"posexplode(sequence({low[1]}, {high[1]}))").alias("py", "cy"))
        # whether a cell is its row's first one is all that the common corner asks, and takes less to deal than its number
        return prefixed(out.withColumn("px", F.col("px") == 0).withColumn("py", F.col("py") == 0), p, *keys, "cx", "cy")

    met = dealt(a, "a_", grow_a).join(dealt(b, "b_", grow_b), [*keys, "cx", "cy"])
    return met.where("(a_px OR b_px) AND (a_py OR b_py)").drop("cx", "cy", "a_px", "a_py", "b_px", "b_py")


def computed(rows: DataFrame, **parts: str) -> DataFrame:
    """``rows`` with columns that are worked out once a row. Filters on plain columns are rewritten in terms of the columns below
    them, so each mention is worked out again and the filter outgrows compiled code; they don't pass a generator."""
    return rows.select("*", F.inline(F.array(F.struct(*(F.expr(e).alias(k) for k, e in parts.items())))))


NOT_SAME = "NOT (a_x = b_x AND a_y = b_y AND a_w = b_w AND a_h = b_h)"


def near_pairs(boxes: DataFrame, reach: float, *keys: str) -> DataFrame:
    """Ordered pairs of rows of different boxes of an image (and group) whose gaps on both axes are at most ``reach``."""
    half = real(reach / 2 + 1)
    pairs = meeting(boxes, boxes, *keys, grow_a=half, grow_b=half, cell=max(128, math.ceil(4 * reach)))
    return pairs.where(f"{NOT_SAME} AND {G.x_overlap('a_', 'b_')} >= -{real(reach)} AND {G.y_overlap('a_', 'b_')} >= -{real(reach)}")


def places(boxes: DataFrame, **also: Column) -> DataFrame:
    """A row for each box of an image with its colour groups (``seas``), and aggregates of the rows that it has."""
    return boxes.groupBy("image_id", *BOX).agg(F.collect_set("sea").alias("seas"), *(c.alias(k) for k, c in also.items()))


def each_once(rows: DataFrame) -> DataFrame:
    """Distinct rows of boxes, dealt by box, so that ``places`` finds them where they are."""
    return rows.repartition("image_id", *BOX).distinct()


def pairwise(boxes: DataFrame, distance: float) -> DataFrame:
    """Directed: different boxes of one group whose connection is above one half, unless the target is over 20 times larger."""
    return pairwise_of(places(boxes), distance)


def pairwise_of(held: DataFrame, distance: float, where: str = "true") -> DataFrame:
    """``pairwise`` of ``places`` that may know more: ``where`` asks it of a pair (a_*, b_*). Pairs come out once, so none is dealt."""
    if distance <= 0:
        return held.select("image_id", box().alias("src"), box().alias("dst")).where("false")
    # two boxes with several groups in common count in the least
    groups = held.select("*", F.explode("seas").alias("sea"), F.expr("if(size(seas) > 1, seas, null)").alias("several")).drop("seas")
    pairs = near_pairs(groups, 3 * distance, "sea")  # beyond, the score is 0
    once = "(a_several IS NULL OR b_several IS NULL OR sea = array_min(array_intersect(a_several, b_several)))"
    pairs = computed(pairs.where(f"NOT ({G.area('a_')} * 20 < {G.area('b_')}) AND {once} AND ({where})"), edge=G.edge_distance("a_", "b_"))
    d = real(distance)
    pairs = pairs.where(f"edge < {real(3 * distance)} AND NOT {G.contains('a_', 'b_')} AND NOT {G.contains('b_', 'a_')}")
    pairs = computed(pairs, near=G.nearness("edge", d), close=G.closeness("a_", "b_", "edge", d), align=G.alignment("a_", "b_", d), shrink=G.shrinkage("a_", "b_", d))
    return pairs.where("near * (close + (1 - close) * align) * shrink * shrink > 0.5e0").select("image_id", box("a_").alias("src"), box("b_").alias("dst"))


def link(pairs: DataFrame) -> DataFrame:
    """Undirected pairs (image_id, src, dst) to directed edges, without those from a box to one over 20 times larger."""
    return both_ways(pairs).where(f"NOT ({G.area('src.')} * 20 < {G.area('dst.')})").distinct()


def series_condition(base: float, distance: float, xo: str = G.x_overlap("a_", "b_"), yo: str = G.y_overlap("a_", "b_"), edge: str = G.edge_distance("a_", "b_")) -> str:
    """Two boxes in a row or a stack: projections, heights, widths and gaps, and a cap on the distance. Overlaps and distance may be columns."""
    both = "(a_is_word AND b_is_word)"
    project, gap = f"CASE WHEN {both} THEN 0.3e0 ELSE 0.5e0 END", f"((a_h + b_h) / 2.0e0) * CASE WHEN {both} THEN 2.5e0 ELSE 1.5e0 END"
    heights = f"({both} OR CAST(least(a_h, b_h) AS DOUBLE) / greatest(a_h, b_h) >= 0.7e0)"
    widths = f"({both} OR CAST(least(a_w, b_w) AS DOUBLE) / greatest(a_w, b_w) >= 0.3e0)"
    row = f"({yo} > 0 AND {xo} <= 0 AND CAST({yo} AS DOUBLE) / least(a_h, b_h) >= {project} AND {heights} AND -{xo} <= {gap})"
    stack = f"({xo} > 0 AND {yo} <= 0 AND CAST({xo} AS DOUBLE) / least(a_w, b_w) >= {project} AND {heights} AND {widths} AND -{yo} <= {gap})"
    large = real(8 * base)
    return f"NOT (least(a_w, a_h) > {large} AND least(b_w, b_h) > {large}) AND ({row} OR {stack}) AND {edge} <= greatest({real(distance)}, least(a_w, a_h, b_w, b_h) / 8.0e0)"


def aligned_series(boxes: DataFrame, base: float, distance: float) -> DataFrame:
    """Undirected pairs (src < dst) of one group in a row or stack."""
    order = "(a_x < b_x OR (a_x = b_x AND (a_y < b_y OR (a_y = b_y AND (a_w < b_w OR (a_w = b_w AND a_h < b_h))))))"
    # one of the two is at most 8 * base wide or high, and the edges are at most an eighth of that, or the distance, apart
    pairs = near_pairs(boxes.select("image_id", "sea", *BOX, "is_word").distinct(), max(distance, base) + 1, "sea")
    pairs = computed(pairs.where(order), xo=G.x_overlap("a_", "b_"), yo=G.y_overlap("a_", "b_"), edge=G.edge_distance("a_", "b_"))
    return pairs.where(series_condition(base, distance, "xo", "yo", "edge")).select("image_id", box("a_").alias("src"), box("b_").alias("dst")).distinct()


def caption_condition() -> str:
    """A small box a beside, above or below a large box b, near for b's size."""
    xo, yo = G.x_overlap("a_", "b_"), G.y_overlap("a_", "b_")
    return f"a_h <= 0.4e0 * b_h AND (({xo} > 0) <> ({yo} > 0)) AND CASE WHEN {xo} > 0 THEN -{yo} ELSE -{xo} END <= least(b_w, b_h) / 8.0e0"


def captions(boxes: DataFrame, base: float) -> DataFrame:
    """Undirected (small, anchor) pairs across groups, carried to all small words of a caption's line."""
    small, large = boxes.where(f"least(w, h) < {real(8 * base)}"), boxes.where(f"least(w, h) >= {real(8 * base)}")
    near = meeting(small, large, grow_b="least(w, h) / 8.0e0").where(caption_condition())
    lines = near.where("a_is_word").select("image_id", F.col("a_line_id").alias("line_id"), box("b_").alias("dst")).distinct()
    spread = small.where("is_word").join(lines, ["image_id", "line_id"]).select("image_id", box().alias("src"), "dst")
    return near.select("image_id", box("a_").alias("src"), box("b_").alias("dst")).union(spread).distinct()


def without(edges: DataFrame, cut: DataFrame, both: bool = True) -> DataFrame:
    """``edges`` without the ``cut`` ones, in both directions."""
    cut = cut.select("image_id", "src", "dst")
    return edges.join(cut.union(reverse(cut)).distinct() if both else cut.distinct(), ["image_id", "src", "dst"], "left_anti")


def outliers(edges: DataFrame) -> DataFrame:
    """Edges of a box with four neighbours or more to one over 8 times their averaged median area."""
    # a box's targets in order of their area: the middle of the list needs no second look at the edges
    led = edges.groupBy("image_id", "src").agg(F.sort_array(F.collect_list(F.struct(F.expr(f"{G.area('dst.')}").alias("area"), "dst"))).alias("to")).where("size(to) >= 4")
    middle = "(to[cast((size(to) - 1) div 2 as int)].area + to[cast(size(to) div 2 as int)].area) / 2.0e0"
    led = led.withColumn("m", F.expr(middle)).where("m > 0 and to[size(to) - 1].area > 8 * m")
    return led.select("image_id", "src", "m", F.inline("to")).where("area > 8 * m").select("image_id", "src", "dst")


def upper_median(values: str) -> str:
    """Expression of the upper median of a collected list."""
    return f"get(sort_array(collect_list({values})), cast(count({values}) div 2 as int))"


def median_word_area(boxes: DataFrame) -> DataFrame:
    """Of every image: the upper median area of its words, 400 without words."""
    return boxes.groupBy("image_id").agg(F.expr(f"coalesce({upper_median('CASE WHEN is_word THEN ' + G.area('') + ' END')}, 400)").alias("median_area"))


def large_box_edges(edges: DataFrame, boxes: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Edges from or to a box without word over 20 times the image's median word area."""
    middle = median_word_area(boxes if words is None else words)
    # sizes are in the edges: most go before the boxes are asked, and then each end in a reading of its own
    few = edges.select("image_id", "src", "dst").join(middle, "image_id", "left").withColumn("limit", F.expr("20 * coalesce(median_area, 400)"))
    few = few.where(f"{G.area('src.')} > limit OR {G.area('dst.')} > limit").select("image_id", "src", "dst", "limit")
    other = boxes.where("NOT is_word").select("image_id", box().alias("box")).distinct()
    of = lambda end: few.where(f"{G.area(f'{end}.')} > limit").join(other.withColumnRenamed("box", end), ["image_id", end], "left_semi").select("image_id", "src", "dst")
    return of("src").union(of("dst")).distinct()


def crossing(edges: DataFrame, boxes: DataFrame, cell: int = 128) -> DataFrame:
    """Edges whose shortest segment cuts through a box that is no neighbour of its ends and doesn't hold it whole.

    Segments and boxes meet by image and grid cell, and a segment is only in cells that it passes, so a task joins what is near. The edges are read several times, so they are written first.
    """
    from pageloom.runtime import Scratch

    edges = Scratch(boxes.sparkSession, "crossing").save(edges.select("image_id", "src", "dst"), "edges")
    seg = flat(edges).select("image_id", "src", "dst", *(F.expr(e).alias(k) for k, e in G.segment("a_", "b_").items())).where("x0 <> x1 OR y0 <> y1")
    cells = lambda low, high: F.sequence(F.floor(F.expr(low) / cell), F.floor(F.expr(high) / cell))
    columns = seg.select("*", F.explode(cells("least(x0, x1)", "greatest(x0, x1)")).alias("cx"))
    # a column of cells is entered and left at these heights; the rows between them are walked, a rounding error wider
    height = lambda x: f"if(x0 = x1, y0, y0 + ({x} - x0) * (y1 - y0) / (x1 - x0))"
    walked = columns.withColumn("in", F.expr(height(f"greatest(least(x0, x1), cx * {cell}.0e0)"))).withColumn("out", F.expr(f"if(x0 = x1, y1, {height(f'least(greatest(x0, x1), (cx + 1) * {cell}.0e0)')})"))
    seg_cells = walked.select("*", F.explode(cells("least(`in`, out) - 0.001e0", "greatest(`in`, out) + 0.001e0")).alias("cy")).drop("in", "out")
    box_cells = boxes.select("image_id", *(F.col(k).alias(f"c_{k}") for k in BOX)).distinct().select("*", F.explode(cells("c_x", "c_x + c_w")).alias("cx")).select("*", F.explode(cells("c_y", "c_y + c_h")).alias("cy"))
    holds = " AND ".join(f"x{k} >= c_x AND x{k} <= {G.right('c_')} AND y{k} >= c_y AND y{k} <= {G.bottom('c_')}" for k in (0, 1))
    cut = seg_cells.join(box_cells, ["image_id", "cx", "cy"]).where(f"NOT ({holds}) AND {G.crosses('c_')}").select("image_id", "src", "dst", box("c_").alias("c")).where("c <> src AND c <> dst").distinct()
    near = edges.select("image_id", "src", "dst").union(reverse(edges)).distinct()
    for end in ("src", "dst"):
        cut = cut.join(near.select("image_id", F.col("src").alias(end), F.col("dst").alias("c")), ["image_id", end, "c"], "left_anti")
    return cut.select("image_id", "src", "dst").distinct()


def heading_limit(boxes: DataFrame) -> DataFrame:
    """1.5e0 times the upper median word height, of images with three words or more."""
    return boxes.where("is_word").groupBy("image_id").agg(F.expr(f"1.5e0 * {upper_median('h')}").alias("tall"), F.count("*").alias("n")).where("n >= 3").drop("n")


def body_to_heading(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """Edges from a body word to a heading word."""
    # heights are in the edges: most go before the words are asked
    steep = edges.select("image_id", "src", "dst").join(heading_limit(boxes), "image_id").where("src.h <= tall AND dst.h > tall").drop("tall")
    word = boxes.where("is_word").select("image_id", box().alias("box")).distinct()
    return steep.join(word.withColumnRenamed("box", "src"), ["image_id", "src"], "left_semi").join(word.withColumnRenamed("box", "dst"), ["image_id", "dst"], "left_semi").select("image_id", "src", "dst")


def pairs_to_heading(boxes: DataFrame, distance: float) -> DataFrame:
    """``body_to_heading`` of ``pairwise``: boxes know before they meet whether they are a heading, so the other pairs are never dealt."""
    words = places(boxes, word=F.expr("bool_or(is_word)")).where("word").drop("word").join(heading_limit(boxes), "image_id")
    return pairwise_of(words.withColumn("heading", F.expr("h > tall")).drop("tall"), distance, "NOT a_heading AND b_heading")


def bridges(edges: DataFrame, boxes: DataFrame, distance: float) -> DataFrame:
    """New edges from a body word back to the exactly two body words that point to it, near it, if it points to neither. The edges are read twice, so they are written first."""
    from pageloom.runtime import Scratch

    edges = Scratch(boxes.sparkSession, "bridges").save(edges.select("image_id", "src", "dst"), "edges")
    body = boxes.where("is_word").join(heading_limit(boxes), "image_id").where("h <= tall").select("image_id", box().alias("box")).distinct()
    into = edges.groupBy("image_id", F.col("dst").alias("t")).agg(F.collect_set("src").alias("sources")).where("size(sources) = 2").join(body.withColumnRenamed("box", "t"), ["image_id", "t"], "left_semi")
    each = into.select("image_id", "t", F.explode("sources").alias("s"))
    fine = flat(each.select("image_id", F.col("t").alias("src"), F.col("s").alias("dst"))).where(f"{G.edge_distance('a_', 'b_')} <= {real(distance)}").select("image_id", "src", "dst")
    fine = fine.join(body.withColumnRenamed("box", "dst"), ["image_id", "dst"], "left_semi").join(edges, ["image_id", "src", "dst"], "left_anti")
    whole = fine.groupBy("image_id", "src").agg(F.count("*").alias("n")).where("n = 2").drop("n")
    return fine.join(whole, ["image_id", "src"], "left_semi").select("image_id", "src", "dst")


def line_extents(boxes: DataFrame) -> DataFrame:
    lines = boxes.where("is_word").groupBy("image_id", "line_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.expr("x + w")).alias("r"), F.max(F.expr("y + h")).alias("b"), F.count("*").alias("n_words"))
    return lines.select("image_id", "line_id", "x", "y", F.expr("greatest(1, r - x)").alias("w"), F.expr("greatest(1, b - y)").alias("h"), "n_words")


def paragraph_links(boxes: DataFrame) -> DataFrame:
    """Undirected pairs of lines (a < b): gap at most the whole average height, x-projections common by 0.3e0 of the narrower."""
    lines = line_extents(boxes)
    xo, yo = G.x_overlap("a_", "b_"), G.y_overlap("a_", "b_")
    cond = f"a_line_id < b_line_id AND greatest(0, -{yo}) <= floor((a_h + b_h) / 2.0e0) AND {xo} > 0 AND {xo} >= 0.3e0 * least(a_w, b_w)"
    return meeting(lines, lines, grow_a="h / 2.0e0", grow_b="h / 2.0e0", cell=512, rows=128).where(cond).select("image_id", F.col("a_line_id").alias("line_a"), F.col("b_line_id").alias("line_b"))


def paragraphs(boxes: DataFrame) -> DataFrame:
    """Lines with the least line of their paragraph, and each line's words."""
    from pageloom.plans.components import connected_components

    found = connected_components(paragraph_links(boxes).select("image_id", F.col("line_a").alias("a"), F.col("line_b").alias("b")), keys=["image_id"])
    lines = line_extents(boxes).withColumn("node", F.col("line_id"))
    return lines.join(found, ["image_id", "node"], "left").select("image_id", "line_id", F.coalesce("component", "node").alias("paragraph_id"), "n_words")


def paragraph_cuts(edges: DataFrame, boxes: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Edges that a paragraph word shouldn't have: to a non-word over 5 (20) times the upper median of its
    paragraph's words, for paragraphs above 20 (10) words; and to a word of another paragraph unless both have 10 words at most.

    Only the word's own edges are looked at. ``words`` gives the lines where they aren't the boxes' own (image_id, line_id, is_word and a box).
    """
    from pageloom.runtime import Scratch

    scratch = Scratch(boxes.sparkSession, "cuts")
    word = scratch.save(paragraph_words(boxes, words), "words")
    other = boxes.where("NOT is_word").select("image_id", box().alias("dst"), F.expr(G.area("")).alias("area")).distinct()
    from_word = scratch.save(edges.select("image_id", "src", "dst").join(word.withColumnRenamed("box", "src"), ["image_id", "src"]), "edges")
    large = from_word.join(other, ["image_id", "dst"]).where(f"area > {_LARGE_FOR.format(p='')}").select("image_id", "src", "dst")
    to = word.select("image_id", F.col("box").alias("dst"), F.col("paragraph_id").alias("p2"), F.col("words").alias("words2"))
    across = from_word.join(to, ["image_id", "dst"]).where("paragraph_id <> p2 AND NOT (words <= 10 AND words2 <= 10)").select("image_id", "src", "dst")
    return large.union(across).distinct()


#: The area above which a box without word is none of a paragraph's.
_LARGE_FOR = "{p}median_area * CASE WHEN {p}words > 20 THEN 5 WHEN {p}words > 10 THEN 20 END"


def paragraph_words(boxes: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """image_id, box, paragraph_id, and the paragraph's number of words and upper median area: a row for each line that a word box is on."""
    of_line = paragraphs(boxes if words is None else words)
    sizes = of_line.groupBy("image_id", "paragraph_id").agg(F.sum("n_words").alias("words"))
    # words are dealt by line, once: what is known of a paragraph comes to its lines, not to each word
    tagged = boxes.where("is_word").select("image_id", *BOX, "line_id").repartition("image_id", "line_id").distinct()
    area = tagged.select("image_id", "line_id", F.expr(G.area("")).alias("area")).join(of_line.select("image_id", "line_id", "paragraph_id"), ["image_id", "line_id"])
    middle = area.groupBy("image_id", "paragraph_id").agg(F.expr(upper_median("area")).alias("median_area"))
    known = of_line.drop("n_words").join(sizes, ["image_id", "paragraph_id"]).join(middle, ["image_id", "paragraph_id"])
    return tagged.join(known, ["image_id", "line_id"]).select("image_id", box().alias("box"), "paragraph_id", "words", "median_area")


def pairs_across_paragraphs(boxes: DataFrame, distance: float) -> DataFrame:
    """``paragraph_cuts`` of ``pairwise``: boxes know their paragraphs before they meet, so the pairs that stay are never dealt. What is read several times is written first."""
    from pageloom.runtime import Scratch

    scratch = Scratch(boxes.sparkSession, "across")
    boxes = scratch.save(boxes, "boxes")
    word = paragraph_words(boxes).select("image_id", "box.*", "paragraph_id", F.expr("words > 10").alias("many"), F.expr(_LARGE_FOR.format(p="")).alias("large_for")).distinct()
    held = scratch.save(places(boxes, other=F.expr("bool_or(NOT is_word)")).join(word, ["image_id", *BOX], "left"), "held")
    cut = f"(b_other AND {G.area('b_')} > a_large_for) OR (a_paragraph_id <> b_paragraph_id AND (a_many OR b_many))"
    return pairwise_of(held, distance, f"a_paragraph_id IS NOT NULL AND ({cut})").distinct()


def build(boxes: DataFrame, height: float, sensitivity: float = 1.0e0, words: DataFrame | None = None) -> DataFrame:
    """All passes in their order: (image_id, src, dst, origin), for any number of images: slices of them go one after another.

    ``words`` (image_id, line_id, is_word and a box) are the recognised words where the boxes tagged as words aren't all of them.
    """
    from pageloom.runtime import by_slices

    return by_slices(lambda b, w=None: passes(b, height, sensitivity, w), boxes, *([] if words is None else [words]))


def passes(boxes: DataFrame, height: float, sensitivity: float = 1.0e0, words: DataFrame | None = None) -> DataFrame:
    """``build`` for the boxes of a slice, which are read many times. Each pass reads the edges that the one before wrote."""
    from pageloom.runtime import Scratch

    scratch = Scratch(boxes.sparkSession, "network")
    boxes = scratch.save(boxes, "boxes")
    base, distance = base_distance(height), base_distance(height, sensitivity)
    pair = lambda e: e.select("image_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    edges = scratch.save(pairwise(boxes, distance), "pairwise")
    origin = pair(edges).withColumn("rank", F.lit(0)).withColumn("origin", F.lit("pairwise"))
    edges = scratch.save(without(edges, outliers(edges)), "outliers")
    for rank, name, added in ((1, "alignedSeries", lambda e: link(aligned_series(boxes, base, distance))), (2, "captions", lambda e: link(captions(boxes, base)))):
        new = scratch.save(added(edges).join(edges, ["image_id", "src", "dst"], "left_anti"), name)
        origin = origin.union(pair(new).withColumn("rank", F.lit(rank)).withColumn("origin", F.lit(name)))
        edges = edges.union(new)
        if name == "alignedSeries":
            edges = scratch.save(without(edges, large_box_edges(edges, boxes, words)), "large")
    edges = scratch.save(edges, "linked")
    edges = scratch.save(without(edges, crossing(edges, boxes)), "crossing")
    edges = scratch.save(without(edges, paragraph_cuts(edges, boxes, words)), "paragraphs")
    edges = scratch.save(without(edges, body_to_heading(edges, boxes), both=False), "headings")
    new = scratch.save(bridges(edges, boxes, distance), "bridges")
    origin = origin.union(pair(new).withColumn("rank", F.lit(-1)).withColumn("origin", F.lit("bridges")))  # bridges overwrite
    first = origin.groupBy("image_id", "a", "b").agg(F.min_by("origin", "rank").alias("origin"))
    edges = edges.union(new)
    return edges.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst")).join(first, ["image_id", "a", "b"], "left").select("image_id", "src", "dst", "origin")


def reach(edges: DataFrame, starts: DataFrame, max_depth: int = 1000, compact: int = 8) -> DataFrame:
    """Directed reachability, level by level: ``edges(a, b)``, ``starts(start)`` to (start, node, depth, parent).

    The start itself has depth 0 and no parent; a node's parent is the least of the nodes one level nearer that lead to it.
    A frontier join a level; every level is written to the shared folder, so cycles end and a lost executor costs a re-read.
    Every ``compact`` levels what has been seen becomes one table. The result has a row a pair, and all pairs are shuffled: numbered
    nodes go through ``reach_by_blocks``, and for what leads where without depths, ``clusters`` keeps members once a component.
    """
    from pageloom.runtime import Scratch

    scratch = Scratch(edges.sparkSession, "reach")
    edges = scratch.save(edges.select("a", "b").distinct(), "edges")
    seen = scratch.save(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.expr("if(true, null, start)").alias("parent")).distinct(), "0")
    front = seen
    for k in range(1, max_depth + 1):
        step = front.select("start", F.col("node").alias("a")).join(edges, "a").groupBy("start", F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        step = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = scratch.save(step.select("start", "node", F.lit(k).alias("depth"), "parent"), str(k))
        if front.isEmpty():
            return seen
        seen = seen.union(front)
        if k % compact == 0:
            seen = scratch.save(seen, f"seen{k}")
    raise RuntimeError(f"not finished in {max_depth} levels")


#: Of the block form of ``reach``: starts are taken in runs of 2^BLOCK_BITS numbers, edges of a block that a task holds, and places of its mark table.
BLOCK_BITS, BLOCK_EDGES, MARKS = 14, 1 << 21, 1 << 24


def reach_of_block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """start, node, depth, parent of one block: ``rows(a, b)`` are edges, and starts where b is null. Level by level for some starts at a time."""
    a, lone = rows["a"].to_numpy(), rows["b"].is_null().to_numpy()
    b = rows["b"].fill_null(0).to_numpy()
    nodes = np.unique(np.concatenate([a, b[~lone]]))
    starts = np.searchsorted(nodes, np.unique(a[lone]))
    source, target = np.searchsorted(nodes, a[~lone]), np.searchsorted(nodes, b[~lone])
    order = np.argsort(source, kind="stable")
    target, first = target[order], np.searchsorted(source[order], np.arange(len(nodes) + 1))
    step = max(1, MARKS // len(nodes))
    for low in range(0, len(starts), step):
        some = starts[low : low + step]
        seen = np.zeros(len(some) * len(nodes), bool)
        who, at, parent, depth = np.arange(len(some)), some, np.full(len(some), -1), 0
        seen[who * len(nodes) + at] = True
        while len(who):
            for k in range(0, len(who), 1 << 16):
                part = slice(k, k + (1 << 16))
                known = parent[part] >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[some[who[part]]]), pa.array(nodes[at[part]]), pa.array(np.full(len(known), depth, np.int32)), pa.array(nodes[parent[part]], mask=~known)], ["start", "node", "depth", "parent"]
                )
            many = first[at + 1] - first[at]
            led = target[np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            key, parent = np.repeat(who, many) * len(nodes) + led, np.repeat(at, many)
            fresh = ~seen[key]
            key, parent = key[fresh], parent[fresh]
            order = np.lexsort((parent, key))
            key, parent = key[order], parent[order]
            least = np.ones(len(key), bool)
            least[1:] = key[1:] != key[:-1]
            key, parent, depth = key[least], parent[least], depth + 1
            seen[key] = True
            who, at = np.divmod(key, len(nodes))


def reach_by_blocks(edges: DataFrame, starts: DataFrame, max_depth: int = 1000, bits: int = BLOCK_BITS, most: int = BLOCK_EDGES) -> DataFrame:
    """``reach`` of long nodes: only the edges that any start of a block leads to are dealt, once a block, and the pairs are made where they are returned.

    Starts near each other in number are a block, so it pays where their ways meet; blocks that lead to over ``most`` edges go level by level, pair by pair.
    """
    from pageloom.runtime import Scratch, ship

    ship(edges.sparkSession)
    scratch = Scratch(edges.sparkSession, "blocks")
    edges = scratch.save(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    starts = scratch.save(starts.select("start").distinct(), "starts")
    block = F.expr(f"shiftright(start, {bits})").alias("block")
    first = starts.where("start is not null").select(block, F.col("start").alias("node"))
    front, seen, dealt = first, first, None
    for k in range(1, max_depth + 1):
        led = scratch.save(front.select("block", F.col("node").alias("a")).join(edges, "a").select("block", "a", "b"), f"edges{k}")
        dealt = led if dealt is None else dealt.union(led)
        step = led.select("block", F.col("b").alias("node")).distinct()
        front = scratch.save(step.join(seen, ["block", "node"], "left_anti"), f"front{k}")
        if front.isEmpty():
            break
        seen = seen.union(front)
        if k % 8 == 0:
            seen = scratch.save(seen, f"seen{k}")
    else:
        raise RuntimeError(f"not finished in {max_depth} levels")
    large = scratch.save(dealt.groupBy("block").count().where(f"count > {most}").select("block"), "large")
    rows = dealt.union(first.select("block", F.col("node").alias("a"), F.lit(None).cast("long").alias("b")))

    def found(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from reach_of_block(pa.Table.from_batches(list(batches)))

    pairs = rows.join(F.broadcast(large), "block", "left_anti").groupBy("block").applyInArrow(found, "start long, node long, depth int, parent long")
    nowhere = starts.where("start is null").select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.col("start").alias("parent"))
    pairs = pairs.union(nowhere)
    return pairs if large.isEmpty() else pairs.union(reach(edges, starts.select("start", block).join(F.broadcast(large), "block", "left_semi").select("start"), max_depth))


def strong_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``edges(a, b)`` to (node, component) of every node of an edge: the least node of its strongly connected component.

    Nodes that lead to each other directly are joined first, by star joins, and count as one from then on. Edges that can be
    in no cycle are dropped. What is left is told apart by marks: the largest node that leads to a node travels forwards, and
    from each node that kept its own mark what leads back to it, among equal marks, is its component.
    """
    from pageloom.plans.components import connected_components
    from pageloom.runtime import Scratch

    scratch, turn = Scratch(edges.sparkSession, "strong"), 0

    def save(df: DataFrame) -> DataFrame:
        nonlocal turn
        turn += 1
        if turn > max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} steps")
        return scratch.save(df, str(turn))

    now = save(edges.select("a", "b").where("a is not null and b is not null").distinct())
    of = save(now.select(F.col("a").alias("node")).union(now.select("b")).distinct().withColumn("component", F.col("node")))

    def merged(found: DataFrame) -> None:
        """found(node, component): components that are one."""
        nonlocal now, of
        found = found.select(F.col("node").alias("old"), F.col("component").alias("new")).where("old <> new")
        of = save(of.join(found, of["component"] == found["old"], "left").select("node", F.coalesce("new", "component").alias("component")))
        for end in ("a", "b"):
            now = now.join(found, now[end] == found["old"], "left").withColumn(end, F.coalesce("new", end)).drop("old", "new")
        now = save(now.where("a <> b").distinct())

    now = save(now.where("a <> b"))
    while not now.isEmpty():
        both = save(now.join(now.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).where("a < b"))
        if not both.isEmpty():
            merged(connected_components(both))
            continue
        # a node that nothing leads to, or that leads nowhere, is in no cycle
        left = save(now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        if left.count() < now.count():
            now = left
            continue
        marks = save(now.select(F.col("a").alias("node")).union(now.select("b")).distinct().withColumn("mark", F.col("node")))
        while True:
            ahead = now.join(marks, now["a"] == marks["node"]).groupBy(F.col("b").alias("node")).agg(F.max("mark").alias("sent"))
            moved = save(marks.join(ahead, "node", "left").select("node", F.greatest("mark", F.coalesce("sent", "mark")).alias("mark"), F.coalesce(F.col("sent") > F.col("mark"), F.lit(False)).alias("changed")))
            marks = moved.select("node", "mark")
            if moved.where("changed").isEmpty():
                break
        same = save(now.join(marks.withColumnsRenamed({"node": "a", "mark": "of_a"}), "a").join(marks.withColumnsRenamed({"node": "b", "mark": "of_b"}), "b").where("of_a = of_b").select("a", "b"))
        back = save(marks.where("node = mark").select("node", "mark"))
        front = back
        while not front.isEmpty():
            front = save(same.join(front.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "mark").distinct().join(back, "node", "left_anti"))
            back = save(back.union(front))
        least = back.groupBy("mark").agg(F.min("node").alias("component"))
        merged(save(back.join(least, "mark").select("node", "component")))
        # edges between different marks join no cycle any more; those of settled components are cut with the next step
        now = save(now.join(same.select("a").union(same.select("b")).distinct(), "a", "left_semi")) if now.count() else now
    return of


def clusters(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges(image_id, src, dst)`` and ``starts(image_id, box)`` (structs) to two tables: (image_id, box, cluster) of the starts, and (cluster, members) with
    all that the boxes of a cluster lead to, themselves included, in order. Boxes that lead to each other share a cluster, so members stand once for all of them.
    """
    from pageloom.runtime import Scratch

    scratch = Scratch(edges.sparkSession, "clusters")
    node = lambda c: F.struct("image_id", F.col(c).alias("box"))
    edges = scratch.save(edges.select(node("src").alias("a"), node("dst").alias("b")).distinct(), "edges")
    of = scratch.save(strong_components(edges), "of")
    asked = starts.select(node("box").alias("node")).distinct().join(of, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))
    asked = scratch.save(asked, "asked")
    ends = edges.join(of.withColumnsRenamed({"node": "a", "component": "of_a"}), "a").join(of.withColumnsRenamed({"node": "b", "component": "of_b"}), "b")
    between = ends.where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
    led = reach(between, asked.select(F.col("cluster").alias("start")).distinct()).select(F.col("start").alias("cluster"), F.col("node").alias("component"))
    held = led.join(of, "component", "left").select("cluster", F.coalesce("node", "component").alias("node"))
    members = held.groupBy("cluster").agg(F.sort_array(F.collect_list("node.box")).alias("members"))
    return asked.select("node.image_id", "node.box", "cluster"), members
