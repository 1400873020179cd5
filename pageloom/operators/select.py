"""Queries on a detected layout: words and boxes, nearest and containing boxes, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.functions import geometry as G
from pageloom.operators.network import BOX, NOT_SAME, meeting
from pageloom.runtime import Scratch


def tag_boxes(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """Each box with the word that covers it best, by at least half of the smaller area; ties to the earlier word."""
    boxes = boxes.select("image_id", *BOX).distinct()
    share = f"{G.overlap('a_', 'b_')} / least({G.area('a_')}, {G.area('b_')})"
    scored = meeting(boxes, words.select("image_id", "word_idx", *BOX)).withColumn("share", F.expr(share)).where("share >= 0.5e0")
    best = scored.groupBy("image_id", *(f"a_{k}" for k in BOX)).agg(F.max_by("b_word_idx", F.struct("share", -F.col("b_word_idx"))).alias("word_idx"))
    best = best.select("image_id", *(F.col(f"a_{k}").alias(k) for k in BOX), "word_idx")
    return boxes.join(best, ["image_id", *BOX], "left").select("image_id", *BOX, "word_idx")


def drop_covered(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """Boxes whose words, each at least half inside, fill half of them drop out; then the words join, each box once."""
    inside = meeting(boxes.select("image_id", *BOX).distinct(), words.select("image_id", *BOX).distinct()).where(f"{G.overlap('a_', 'b_')} / {G.area('b_')} >= 0.5e0")
    full = inside.groupBy("image_id", *(f"a_{k}" for k in BOX)).agg(F.sum(F.expr(G.area("b_"))).alias("s")).where(f"s >= 0.5e0 * {G.area('a_')}")
    full = full.select("image_id", *(F.col(f"a_{k}").alias(k) for k in BOX))
    return boxes.select("image_id", *BOX).join(full, ["image_id", *BOX], "left_anti").union(words.select("image_id", *BOX)).distinct()


def drop_letters(boxes: DataFrame, words: DataFrame) -> DataFrame:
    """Without boxes that lie to 0.8e0 in a word of at least twice their area."""
    cond = f"{G.overlap('a_', 'b_')} / {G.area('a_')} >= 0.8e0 AND {G.area('b_')} >= 2 * {G.area('a_')}"
    letters = meeting(boxes.select("image_id", *BOX).distinct(), words.select("image_id", *BOX).distinct()).where(cond).select("image_id", *(F.col(f"a_{k}").alias(k) for k in BOX))
    return boxes.join(letters, ["image_id", *BOX], "left_anti")


#: Up to so many images are sent to all executors to pick their boxes; beyond, all boxes are dealt.
IMAGES_SENT = 1 << 18


def of_images(boxes: DataFrame, events: DataFrame) -> DataFrame:
    """Boxes of the events' images; where these are many, all of them."""
    images = Scratch(events.sparkSession, "images").save(events.select("image_id").distinct(), "images")
    return boxes.join(F.broadcast(images), "image_id", "left_semi") if images.count() <= IMAGES_SENT else boxes


def nearest(events: DataFrame, boxes: DataFrame, cell: int = 128) -> DataFrame:
    """The nearest box of each event's image and its squared distance; ties to the last box in order of y, x, h, w.

    Boxes lie in the grid cells that they touch. An event first looks at the boxes of its own cell and the eight around it, which
    are lists by cell, so an event is one row that travels once. What may have a nearer box outside looks into rings that double,
    and stops when its best box is nearer than any box outside the square can be, or when the square holds all boxes of the image.
    So an event meets the boxes around it only; each round is written to the shared folder.
    """
    scratch = Scratch(events.sparkSession, "nearest")
    at = lambda e: F.expr(f"cast(floor(({e}) / {cell}) as int)")
    events = events.select("image_id", "event_id", "px", "py", at("px").alias("ex"), at("py").alias("ey"))
    cells = of_images(boxes.select("image_id", *BOX), events).distinct().select("*", F.explode(F.sequence(at("x"), at("x + w"))).alias("cx")).select("*", F.explode(F.sequence(at("y"), at("y + h"))).alias("cy"))
    cells = scratch.save(cells, "cells")
    extent = cells.groupBy("image_id").agg(F.min("cx").alias("x_low"), F.max("cx").alias("x_high"), F.min("cy").alias("y_low"), F.max("cy").alias("y_high"))
    best = "struct<near:bigint,y:int,x:int,h:int,w:int>"
    border = lambda ring: f"least(px - {cell} * ex, {cell} * (ex + 1) - px, py - {cell} * ey, {cell} * (ey + 1) - py) + {cell} * {ring}"
    done = lambda ring: F.expr(f"(ex - {ring} <= x_low and ex + {ring} >= x_high and ey - {ring} <= y_low and ey + {ring} >= y_high) or coalesce(-best.near < cast({border(ring)} as bigint) * ({border(ring)}), false)")
    # the boxes that a cell's events look at, each once, with the extent of the image
    around = cells.select("image_id", F.explode(F.expr("sequence(cx - 1, cx + 1)")).alias("ex"), "cy", F.struct("y", "x", "h", "w").alias("box")).select("image_id", "ex", F.explode(F.expr("sequence(cy - 1, cy + 1)")).alias("ey"), "box")
    around = around.groupBy("image_id", "ex", "ey").agg(F.collect_set("box").alias("near_boxes")).join(extent, "image_id")
    first = F.expr(f"array_max(transform(near_boxes, b -> named_struct('near', -({G.point_gap2('', 'b.')}), 'y', b.y, 'x', b.x, 'h', b.h, 'w', b.w)))").cast(best)
    now = events.join(around, ["image_id", "ex", "ey"], "left").withColumn("best", first).drop("near_boxes")
    now = scratch.save(now.withColumn("done", F.coalesce(done(1), F.lit(False))), "1")
    told = lambda rows: rows.where("done").select("event_id", (-F.col("best.near")).alias("gap2"), *(F.col(f"best.{k}").alias(k) for k in BOX))
    found = told(now)
    open_ = now.where("not done").select("image_id", "event_id", "px", "py", "ex", "ey", "best").join(extent, "image_id")
    seen, ring, turn = 1, 2, 1
    while not open_.isEmpty():
        turn += 1
        span = lambda v, low, high: f"sequence(greatest({low}, {v} - {ring}), least({high}, {v} + {ring}))"
        # a square that doesn't reach the image's boxes yet has no cells
        looked = open_.where(f"ex + {ring} >= x_low and ex - {ring} <= x_high and ey + {ring} >= y_low and ey - {ring} <= y_high").select("image_id", "event_id", "px", "py", "ex", "ey", F.explode(F.expr(span("ex", "x_low", "x_high"))).alias("cx"), "y_low", "y_high")
        looked = looked.select("image_id", "event_id", "px", "py", "cx", F.explode(F.expr(span("ey", "y_low", "y_high"))).alias("cy"), "ex", "ey").where(f"greatest(abs(cx - ex), abs(cy - ey)) > {seen}")
        met = looked.join(cells, ["image_id", "cx", "cy"]).groupBy("event_id").agg(F.max(F.struct((-F.expr(G.point_gap2("", ""))).alias("near"), "y", "x", "h", "w")).cast(best).alias("new"))
        now = open_.join(met, "event_id", "left").withColumn("best", F.greatest("best", "new")).drop("new")
        now = scratch.save(now.withColumn("done", done(ring)), str(turn))
        found = found.unionByName(told(now))
        open_, seen, ring = now.where("not done").drop("done"), ring, 2 * ring
    return found


def containing(events: DataFrame, boxes: DataFrame) -> DataFrame:
    """The smallest box that holds each event's point; right and bottom edges are outside."""
    points = events.select("image_id", "event_id", F.col("px").alias("x"), F.col("py").alias("y"), F.lit(0).alias("w"), F.lit(0).alias("h"))
    held = meeting(points, of_images(boxes.select("image_id", *BOX), events).distinct()).where(f"a_x >= b_x AND a_x < {G.right('b_')} AND a_y >= b_y AND a_y < {G.bottom('b_')}")
    best = held.groupBy(F.col("a_event_id").alias("event_id")).agg(F.min_by(F.struct(*(F.col(f"b_{k}").alias(k) for k in BOX)), F.struct(F.expr(G.area("b_")), "b_y", "b_x", "b_h", "b_w")).alias("b"))
    return best.select("event_id", *(F.col(f"b.{k}").alias(k) for k in BOX))


def maximal(boxes: DataFrame) -> DataFrame:
    """Boxes that no other box of their image and group contains."""
    one = boxes.select("image_id", "sea", *BOX).distinct()
    held = meeting(one, one, "sea").where(f"{NOT_SAME} AND {G.contains('b_', 'a_')}").select("image_id", "sea", *(F.col(f"a_{k}").alias(k) for k in BOX))
    return one.join(held, ["image_id", "sea", *BOX], "left_anti")


def pick_display(points: DataFrame, displays: DataFrame, main: int = 0) -> DataFrame:
    """event_id and the first display (least number) that holds each point, else the main one. ``displays`` is the desk's handful of screens."""
    held = points.join(F.broadcast(displays), F.expr(f"px >= x AND px < {G.right('')} AND py >= y AND py < {G.bottom('')}"), "left")
    return held.groupBy("event_id").agg(F.coalesce(F.min("display"), F.lit(main)).alias("display"))


def selection_rect(boxes: DataFrame, *keys: str, padding: int = 8, width: int = 1200, height: int = 800) -> DataFrame:
    """The padded extent of each key's boxes, clamped to the view."""
    grown = boxes.groupBy(*keys).agg(F.min("x").alias("l"), F.min("y").alias("t"), F.max(F.expr(G.right(""))).alias("r"), F.max(F.expr(G.bottom(""))).alias("b"))
    return grown.select(*keys, F.expr(f"greatest(0, l - {padding})").alias("left"), F.expr(f"greatest(0, t - {padding})").alias("top"), F.expr(f"least({width}, r + {padding})").alias("right"), F.expr(f"least({height}, b + {padding})").alias("bottom"))
