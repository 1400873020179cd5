"""Pixel-plane operators over long tables (image_id, y, x, value), all images at once.

Windows partition by (image, row) or (image, column), so no task holds more than one
line of an image. Missing neighbours count as 0; frames are clipped at the borders.
For whole frames as one binary row each, see ``pageloom.sources.frames``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pageloom.plans.components import connected_components
from pageloom.runtime import Scratch


def linear(c: str) -> str:
    """sRGB byte to linear light."""
    v = f"({c} / 255.0e0)"
    return f"(CASE WHEN {v} <= 0.04045e0 THEN {v} / 12.92e0 ELSE pow(({v} + 0.055e0) / 1.055e0, 2.4e0) END)"


def lab(r: str = "r", g: str = "g", b: str = "b") -> dict[str, str]:
    """8-bit L, a, b of an sRGB pixel (D65): L scaled to 255, a and b shifted by 128."""
    r, g, b = linear(r), linear(g), linear(b)
    # fixed values: the sRGB to XYZ matrix and the D65 white point
    x = f"((0.4124564e0 * {r} + 0.3575761e0 * {g} + 0.1804375e0 * {b}) / 0.95047e0)"
    y = f"(0.2126729e0 * {r} + 0.7151522e0 * {g} + 0.0721750e0 * {b})"
    z = f"((0.0193339e0 * {r} + 0.1191920e0 * {g} + 0.9503041e0 * {b}) / 1.08883e0)"
    f = lambda t: f"(CASE WHEN {t} > pow(6.0e0 / 29, 3) THEN pow({t}, 1.0e0 / 3) ELSE {t} / (3 * pow(6.0e0 / 29, 2)) + 4.0e0 / 29 END)"
    clamp = lambda v: f"CAST(least(255, greatest(0, round({v}))) AS INT)"
    return {"l": clamp(f"(116 * {f(y)} - 16) * 255 / 100"), "a": clamp(f"500 * ({f(x)} - {f(y)}) + 128"), "b": clamp(f"200 * ({f(y)} - {f(z)}) + 128")}


def to_lab(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "y", "x", *(F.expr(e).alias(f"lab_{k}") for k, e in lab().items()))


def dilate(plane: DataFrame, kx: int, ky: int, value: str = "v") -> DataFrame:
    return _slide(plane, kx, ky, value, F.max)


def erode(plane: DataFrame, kx: int, ky: int, value: str = "v") -> DataFrame:
    return _slide(plane, kx, ky, value, F.min)


def _slide(plane: DataFrame, kx: int, ky: int, value: str, agg) -> DataFrame:
    """A clipped window of 2 * (k div 2) + 1 places along rows, then along columns."""
    row = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-(kx // 2), kx // 2)
    column = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-(ky // 2), ky // 2)
    across = plane.select("image_id", "y", "x", agg(value).over(row).alias(value))
    return across.select("image_id", "y", "x", agg(value).over(column).alias(value))


def close(plane: DataFrame, kx: int, ky: int, value: str = "v") -> DataFrame:
    return erode(dilate(plane, kx, ky, value), kx, ky, value)


def dense(plane: DataFrame, width: int, height: int, value: str = "v") -> DataFrame:
    """All places of every image; missing ones are 0."""
    grid = plane.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return grid.join(plane.select("image_id", "y", "x", value), ["image_id", "y", "x"], "left").na.fill(0, [value])


def gradients(plane: DataFrame, value: str = "v") -> DataFrame:
    """gx, gy and the saturated Sobel magnitude; 0 on the border. The plane is dense."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    across = plane.select(
        "image_id", "y", "x",
        (F.lead(value).over(row) - F.lag(value).over(row)).alias("dx"),
        (F.lag(value).over(row) + 2 * F.col(value) + F.lead(value).over(row)).alias("sx"),
    )
    both = across.select(
        "image_id", "y", "x",
        (F.lag("dx").over(column) + 2 * F.col("dx") + F.lead("dx").over(column)).alias("gx"),
        (F.lead("sx").over(column) - F.lag("sx").over(column)).alias("gy"),
    )
    return both.select("image_id", "y", "x", "gx", "gy", F.expr("if(gx + gy is null, 0, least(255, cast(floor(sqrt(cast(gx * gx + gy * gy as double))) as int)))").alias("mag"))


#: The neighbours (dy, dx) to compare with, by octant of the gradient: strictly above the first, not below the second.
_OCTANT = "CASE WHEN 5 * abs(gy) < 2 * abs(gx) THEN 0 WHEN 5 * abs(gx) < 2 * abs(gy) THEN 1 WHEN (gx > 0) = (gy > 0) THEN 2 ELSE 3 END"


def thin(edges: DataFrame) -> DataFrame:
    """Non-maximum suppression of ``gradients``: nms is mag where it is a ridge, else 0."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    across = edges.select("*", F.lag("mag").over(row).alias("w"), F.lead("mag").over(row).alias("e"))
    names = {"n": ("mag", F.lag), "s": ("mag", F.lead), "nw": ("w", F.lag), "se": ("e", F.lead), "ne": ("e", F.lag), "sw": ("w", F.lead)}
    near = across.select("*", *(f(c).over(column).alias(k) for k, (c, f) in names.items()))
    first, second = (F.expr(f"CASE {_OCTANT} WHEN 0 THEN {p[0]} WHEN 1 THEN {p[1]} WHEN 2 THEN {p[2]} ELSE {p[3]} END") for p in (("w", "n", "nw", "ne"), ("e", "s", "se", "sw")))
    kept = (F.col("mag") > 0) & F.col("gx").isNotNull() & F.col("gy").isNotNull() & (F.col("mag") > first) & (F.col("mag") >= second)
    return near.select("image_id", "y", "x", F.when(kept, F.col("mag")).otherwise(0).alias("nms"))


def components(mask: DataFrame) -> DataFrame:
    """8-connected components of a sparse mask (image_id, y, x): each place with the least place (y * 2^32 + x) of its image's component."""
    node = "cast(y as bigint) * 4294967296 + x"
    places = Scratch(mask.sparkSession, "mask").save(mask.select("image_id", "y", "x"), "places")
    # each pair of neighbours once
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))))
    ahead = places.select("image_id", "y", "x", F.explode(steps).alias("s")).select("image_id", F.expr(node).alias("a"), F.expr("y + s.dy").alias("y"), F.expr("x + s.dx").alias("x"))
    edges = ahead.join(places, ["image_id", "y", "x"]).select("image_id", "a", F.expr(node).alias("b"))
    found = connected_components(edges, keys=["image_id"])
    return places.withColumn("node", F.expr(node)).join(found, ["image_id", "node"], "left").select("image_id", "y", "x", F.coalesce("component", "node").alias("component"))


def component_boxes(labelled: DataFrame) -> DataFrame:
    box = labelled.groupBy("image_id", "component").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return box.select("image_id", "x", "y", F.expr("x1 - x + 1").alias("w"), F.expr("y1 - y + 1").alias("h"))


def hysteresis(thinned: DataFrame, low: int, high: int) -> DataFrame:
    """Places of nms >= low whose component reaches high."""
    weak = thinned.where(f"nms >= {low}")
    strong = components(weak).join(weak, ["image_id", "y", "x"])
    reached = strong.groupBy("image_id", "component").agg(F.max("nms").alias("top")).where(f"top >= {high}").select("image_id", "component")
    return strong.join(reached, ["image_id", "component"], "left_semi").select("image_id", "y", "x")


def canny(plane: DataFrame, low: int, high: int, value: str = "v") -> DataFrame:
    return hysteresis(Scratch(plane.sparkSession, "canny").save(thin(gradients(plane, value)), "thin"), low, high)


def selectable(boxes: DataFrame, kx: int, ky: int, image_area: int) -> DataFrame:
    """Different boxes at least as large as the kernel and at most 0.6e0 of the image."""
    return boxes.where(f"w >= {kx} and h >= {ky} and cast(w as bigint) * h <= 0.6e0 * {image_area}").dropDuplicates(["image_id", "x", "y", "w", "h"])


def crop(pixels: DataFrame, x: float, y: float, w: float, h: float) -> DataFrame:
    """Pixels inside a rectangle rounded outwards."""
    return pixels.where(f"x >= floor({x}) and x < ceil({x + w}) and y >= floor({y}) and y < ceil({y + h})")
