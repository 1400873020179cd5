"""From the pixels of frames to boxes, colour groups, tags and the box network: the operators of this package in a row.

Everything is keyed by image_id, so any number of frames goes through the same joins. Frames
(image_id, y, x, r, g, b) share one size; recognised words (image_id, word_idx, line_id and a
box) come from outside. Intermediate tables are written to the shared folder, as later steps
read them several times.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from pageloom.operators import colour as C, network as N, pixels as P, select as S, tiles as T
from pageloom.runtime import Scratch
from pageloom.sources.frames import frame_pixels

# fixed values: the height that sizes are tuned for, kernel and margin at that height, edge thresholds
TUNED_HEIGHT, KERNEL, MARGIN, LOW, HIGH = 1964, (8, 5), 2, 3, 40


def kernel_of(height: float) -> tuple[int, int]:
    return tuple(max(1, math.floor(k * height / TUNED_HEIGHT)) for k in KERNEL)


def margin_of(height: float) -> int:
    return max(1, math.ceil(MARGIN * height / TUNED_HEIGHT))


def lab_plane(pixels: DataFrame) -> DataFrame:
    """image_id, y, x, l, a, b"""
    return P.to_lab(pixels).withColumnsRenamed({f"lab_{k}": k for k in "lab"})


def detect_boxes(pixels: DataFrame, width: int, height: int, kernel: tuple[int, int], side: int = T.SIDE) -> DataFrame:
    """Boxes of the closed edges of the l plane that pass the size filter. ``pixels`` has l, or r, g and b, of which tiles make it."""
    edges = T.Edges(T.Grid(width, height, side), LOW, HIGH, kernel)
    return edge_boxes(edges, T.tiles_of_pixels(pixels, edges.grid, ("l",) if "l" in pixels.columns else ("r", "g", "b")))


def edge_boxes(edges: T.Edges, tiles: DataFrame) -> DataFrame:
    """image_id, x, y, w, h of tiles with the halo of ``edges``."""
    return P.selectable(edges.boxes(tiles), *edges.closing, edges.grid.width * edges.grid.height).select("image_id", *N.BOX)


def keep_stable(boxes: DataFrame, words: DataFrame, blocks: DataFrame, grid: T.Grid, margin: int) -> DataFrame:
    """Boxes with their colour pair: words' own boxes with a sample inside the image, and of the others the calm ones, whose pair is their perimeter's median twice.

    ``blocks`` are the image's colours as ``C.colour_blocks`` packs them; a block answers all boxes that ask it, so no row a pixel is sorted.
    """
    own = words.select("image_id", *N.BOX).distinct()
    colour = lambda l, a, b: F.struct(F.col(l).cast("int").alias("l"), F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b"))
    pairs = C.dominant_pair_of_blocks(boxes.join(own, ["image_id", *N.BOX], "left_semi"), blocks, grid)
    pairs = pairs.select("image_id", *N.BOX, *(colour(f"{c}.l", f"{c}.a", f"{c}.b").alias(c) for c in ("primary", "secondary")))
    scratch = Scratch(boxes.sparkSession, "samples")
    samples = scratch.save(C.perimeter(boxes.join(own, ["image_id", *N.BOX], "left_anti"), margin), "places")
    plane = scratch.save(C.colours_at(samples, blocks, grid), "colours")
    calm = C.calmness(samples, plane, ("l", "a", "b"), HIGH * HIGH).where("calm").select("image_id", "fx", "fy", "fw", "fh")
    around = C.perimeter_colours(samples, plane, "l", "a", "b").join(calm, ["image_id", "fx", "fy", "fw", "fh"], "left_semi")
    around = around.select("image_id", *(F.col(f"f{k}").alias(k) for k in N.BOX), colour("l", "a", "b").alias("primary"), colour("l", "a", "b").alias("secondary"))
    return pairs.union(around)


@dataclass
class Detection:
    """boxes (image_id, x, y, w, h, sea, is_word, line_id, word_idx), edges (image_id, src, dst, origin), words as given."""

    boxes: DataFrame
    edges: DataFrame
    words: DataFrame


def detect_frames(frames: DataFrame, words: DataFrame, width: int, height: int, tuned_as: float | None = None, sensitivity: float = 1.0) -> Detection:
    """All steps for frames (image_id, height, width, channels, data) of one size, whose tiles are cut where they are read."""
    edges = T.Edges(T.Grid(width, height), LOW, HIGH, kernel_of(tuned_as or height))
    found = Scratch(frames.sparkSession, "frames").save(edge_boxes(edges, T.tiles_of_frames(frames, edges.grid)), "found")
    return detect(frame_pixels(frames), words, width, height, tuned_as, sensitivity, found)


def observed(boxes: DataFrame, observation: Observation | str) -> DataFrame:
    """``boxes`` of a detection, which also count, while they are written, boxes, words, colour groups and the boxes' area.

    The numbers of an ``Observation`` are there after the write, without another job; by name, listeners get them,
    on a stream with each batch's progress. A colour group counts at its founder, the first of its boxes in the fixed order.
    """
    counts = [F.count(F.lit(1)).alias("boxes"), F.count_if("is_word").alias("words"), F.count_if("founder").alias("seas"), F.sum(F.expr("cast(w as bigint) * h")).alias("area")]
    return boxes.observe(observation, *counts)


def detect(pixels: DataFrame, words: DataFrame, width: int, height: int, tuned_as: float | None = None, sensitivity: float = 1.0, found: DataFrame | None = None, observation: Observation | str | None = None) -> Detection:
    """All steps. ``tuned_as`` is the height that kernels and distances follow, the frames' own if not given; ``found`` are the edges' boxes if they are known;
    ``observation`` gets the counts of ``observed`` as the boxes are written.

    Images without pixels or without boxes have no rows; words may be an empty table; repeated words count once a box.
    """
    scratch = Scratch(pixels.sparkSession, "detect")
    scale_height = tuned_as or height
    plane = scratch.save(lab_plane(pixels), "plane")
    words = scratch.save(words.select("image_id", "word_idx", "line_id", *N.BOX), "words")
    found = found if found is not None else scratch.save(detect_boxes(plane, width, height, kernel_of(scale_height)), "found")
    chosen = scratch.save(S.drop_letters(S.drop_covered(found, words), words), "chosen")
    grid = T.Grid(width, height, C.BLOCK)
    blocks = scratch.save(C.colour_blocks(plane, grid), "blocks")
    pairs = scratch.save(keep_stable(chosen, words, blocks, grid, margin_of(scale_height)), "pairs")
    grouped = scratch.save(C.seas(pairs).select("image_id", *N.BOX, F.col("sea_id").alias("sea"), "founder"), "seas")
    tags = S.tag_boxes(grouped, words).where("word_idx is not null").join(words.select("image_id", "word_idx", "line_id").dropDuplicates(["image_id", "word_idx"]), ["image_id", "word_idx"])
    boxes = grouped.join(tags, ["image_id", *N.BOX], "left").select("image_id", *N.BOX, "sea", F.col("word_idx").isNotNull().alias("is_word"), "line_id", "word_idx", "founder")
    boxes = scratch.save(observed(boxes, observation) if observation is not None else boxes, "boxes").drop("founder")
    return Detection(boxes, N.build(boxes.drop("word_idx"), scale_height, sensitivity, words.withColumn("is_word", F.lit(True))), words)


def debug_edges(found: Detection) -> DataFrame:
    """The network as arrows between the boxes' middles with the pass that made them, and paragraphs of more than 20 words as their lines' extents."""
    arrow = lambda e: [F.expr(f"{e}.x + {e}.w / 2.0e0"), F.expr(f"{e}.y + {e}.h / 2.0e0")]
    arrows = found.edges.select("image_id", F.col("origin").alias("what"), *arrow("src"), *arrow("dst")).toDF("image_id", "what", "x0", "y0", "x1", "y1")
    words = found.words.withColumn("is_word", F.lit(True))
    lines = N.line_extents(words).select("image_id", "line_id", *N.BOX).join(N.paragraphs(words), ["image_id", "line_id"])
    extent = lines.groupBy("image_id", "paragraph_id").agg(F.sum("n_words").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.expr("x + w")).alias("x1"), F.max(F.expr("y + h")).alias("y1")).where("n > 20")
    return arrows.union(extent.select("image_id", F.lit("paragraph"), *(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))))


def counts(found: Detection) -> DataFrame:
    """Boxes, colour groups and tagged boxes of each image."""
    return found.boxes.groupBy("image_id").agg(F.count("*").alias("boxes"), F.countDistinct("sea").alias("seas"), F.expr("count_if(is_word)").alias("words"))
