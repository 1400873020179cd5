"""Colour of boxes: perimeter medians, calmness, and ordered first-match clustering.

Clustering is a fold over an ordered array: a sample joins the first cluster near it.
The order is fixed (row-major samples, boxes by y, x, h, w), so results don't depend
on partitioning. A fold's state is the list of clusters of one box or image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.operators import tiles as T

#: The side of the squares that colours are packed in.
BLOCK = 64


def perimeter(boxes: DataFrame, margin: int = 2, gap: int = 10) -> DataFrame:
    """Sample places around each box, ``margin`` outside it, every ``gap`` pixels: side (0 top, 1 bottom, 2 left, 3 right), k, y, x."""
    x0, y0, x1, y1 = f"x - {margin}", f"y - {margin}", f"x + w + {margin}", f"y + h + {margin}"
    across, down = f"sequence(x, x + w - 1, {gap})", f"sequence(y, y + h - 1, {gap})"
    sides = ", ".join(
        [f"transform({across}, (p, i) -> struct({s} AS side, i AS k, {e} AS y, p AS x))" for s, e in ((0, y0), (1, y1))]
        + [f"transform({down}, (p, i) -> struct({s} AS side, i AS k, p AS y, {e} AS x))" for s, e in ((2, x0), (3, x1))]
    )
    keys = ["image_id", *(F.col(k).alias(f"f{k}") for k in ("x", "y", "w", "h"))]
    return boxes.select(*keys, F.explode(F.expr(f"concat({sides})")).alias("s")).select("image_id", "fx", "fy", "fw", "fh", "s.side", "s.k", F.col("s.y").cast("int").alias("y"), F.col("s.x").cast("int").alias("x"))


@F.udtf(returnType="side int, k int, y int, x int", useArrow=True)
class PerimeterSamples:
    """The sample places around one box, as a table function: perimeter_samples(x, y, w, h, margin, gap)."""

    def eval(self, x: int, y: int, w: int, h: int, margin: int, gap: int):
        if None in (x, y, w, h):
            return
        for side, at in ((0, y - margin), (1, y + h + margin)):
            for k, p in enumerate(range(x, x + w, gap)):
                yield side, k, at, p
        for side, at in ((2, x - margin), (3, x + w + margin)):
            for k, p in enumerate(range(y, y + h, gap)):
                yield side, k, p, at


def register_functions(spark: SparkSession) -> None:
    """Makes ``perimeter_samples`` known to SQL, for FROM ... , LATERAL."""
    spark.udtf.register("perimeter_samples", PerimeterSamples)


def perimeter_lateral(boxes: DataFrame, margin: int = 2, gap: int = 10) -> DataFrame:
    """``perimeter`` by the table function; the expression there is the faster one, as it needs no Python worker."""
    register_functions(boxes.sparkSession)
    text = "SELECT b.image_id, b.x AS fx, b.y AS fy, b.w AS fw, b.h AS fh, s.side, s.k, s.y, s.x FROM {boxes} b, LATERAL perimeter_samples(b.x, b.y, b.w, b.h, {margin}, {gap}) s"
    return boxes.sparkSession.sql(text, boxes=boxes, margin=margin, gap=gap)


_OF_BOX = ("image_id", "fx", "fy", "fw", "fh")


def perimeter_colours(samples: DataFrame, plane: DataFrame, *channels: str) -> DataFrame:
    """Upper medians of the channels over a box's samples inside the image, and their number; 0 without any."""
    held = samples.join(plane, ["image_id", "y", "x"], "left")
    return held.groupBy(*_OF_BOX).agg(*(F.expr(f"coalesce(get(sort_array(collect_list({c})), cast(count({c}) div 2 as int)), 0)").alias(c) for c in channels), F.count(channels[0]).alias("n"))


def calmness(samples: DataFrame, plane: DataFrame, channels: tuple[str, ...], limit: int = 1600) -> DataFrame:
    """A box is calm if at least 0.7 of the steps between successive samples of a side are below the limit, or there are none; without samples inside the image it isn't."""
    before = f"OVER (PARTITION BY {', '.join(_OF_BOX)}, side ORDER BY k)"
    step = " + ".join(f"pow({c} - lag({c}) IGNORE NULLS {before}, 2)" for c in channels)
    steps = samples.join(plane, ["image_id", "y", "x"], "left").withColumn("d", F.expr(step))
    counts = steps.groupBy(*_OF_BOX).agg(F.count("d").alias("steps"), F.count(F.when(F.col("d") < limit, 1)).alias("smooth"), F.count(channels[0]).alias("n"))
    return counts.select(*_OF_BOX, "steps", "smooth", F.expr("n > 0 and 10 * smooth >= 7 * steps").alias("calm"))


def leaders(values: str, limit: int) -> str:
    """Fold of an ordered array of (l, a, b) structs into clusters (sl, sa, sb, n): a sample joins the first
    cluster whose truncated mean is nearer than ``limit`` (squared); most members first, then the earlier cluster."""
    zero = "cast(array() as array<struct<sl:bigint,sa:bigint,sb:bigint,n:bigint>>)"
    d = lambda c: f"(c.s{c} div c.n - v.{c}) * (c.s{c} div c.n - v.{c})"
    near = f"{d('l')} + {d('a')} + {d('b')} < {limit}"
    hit = f"array_position(transform(acc, c -> {near}), true)"
    joined = f"transform(acc, (c, i) -> if(i + 1 = {hit}, named_struct('sl', c.sl + v.l, 'sa', c.sa + v.a, 'sb', c.sb + v.b, 'n', c.n + 1L), c))"
    new = "concat(acc, array(named_struct('sl', cast(v.l as bigint), 'sa', cast(v.a as bigint), 'sb', cast(v.b as bigint), 'n', 1L)))"
    folded = f"aggregate({values}, {zero}, (acc, v) -> if({hit} > 0, {joined}, {new}))"
    ranked = f"array_sort(transform({folded}, (c, i) -> named_struct('k', -c.n, 'i', i, 'l', c.sl div c.n, 'a', c.sa div c.n, 'b', c.sb div c.n)))"
    return f"transform({ranked}, c -> named_struct('l', c.l, 'a', c.a, 'b', c.b, 'n', -c.k))"


def dominant_pair(boxes: DataFrame, plane: DataFrame, per_box: int = 400, limit: int = 36, apart: int = 900) -> DataFrame:
    """Each box's largest colour cluster and the first later one that is far from it (else the same): primary, secondary."""
    stride = f"greatest(1, cast(floor(sqrt(cast(w as double) * h / {per_box})) as int))"
    grid = boxes.select("image_id", "x", "y", "w", "h", F.expr(f"explode(sequence(y, y + h - 1, {stride}))").alias("sy")).select("*", F.expr(f"explode(sequence(x, x + w - 1, {stride}))").alias("sx"))
    held = grid.join(plane.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "l", "a", "b"), ["image_id", "sy", "sx"])
    ordered = held.groupBy("image_id", "x", "y", "w", "h").agg(F.sort_array(F.collect_list(F.struct("sy", "sx", "l", "a", "b"))).alias("v"))
    return _pair(ordered, limit, apart)


def _pair(ordered: DataFrame, limit: int, apart: int) -> DataFrame:
    """primary and secondary of boxes with their samples v, an ordered array of structs l, a, b."""
    found = ordered.select("image_id", "x", "y", "w", "h", F.expr(leaders("v", limit)).alias("c"))
    far = "(c[0].l - q.l) * (c[0].l - q.l) + (c[0].a - q.a) * (c[0].a - q.a) + (c[0].b - q.b) * (c[0].b - q.b) > " + str(apart)
    return found.select("image_id", "x", "y", "w", "h", F.expr("c[0]").alias("primary"), F.expr(f"coalesce(get(filter(c, q -> {far}), 0), c[0])").alias("secondary"))


def colour_blocks(plane: DataFrame, grid: T.Grid) -> DataFrame:
    """Tiles of the places of a plane (l, a, b, from 0 to 255): whether there is one, l, a and b. Places without a colour don't count."""
    return T.tiles_of_pixels(plane.where("l is not null and a is not null and b is not null").select("*", F.lit(1).alias("here")), grid, ("here", "l", "a", "b"))


def colours_at(places: DataFrame, blocks: DataFrame, grid: T.Grid) -> DataFrame:
    """image_id, y, x, l, a, b of those of ``places`` (image_id, y, x) that the blocks have, each once."""
    inside = places.where(f"y >= 0 and y < {grid.height} and x >= 0 and x < {grid.width}").select("image_id", "y", "x").distinct()
    tile, place = f"cast(y div {grid.side} * {grid.across} + x div {grid.side} as int)", f"cast(y as bigint) * {grid.width} + x"
    asked = inside.groupBy("image_id", F.expr(tile).alias("tile")).agg(F.collect_list(F.expr(place)).alias("asked"))

    def look(image: int, tile: int, planes: np.ndarray, asked: list[int]) -> Iterator[pa.RecordBatch]:
        y0, _, x0, _ = grid.region(tile)
        y, x = np.divmod(np.array(asked, np.int64), grid.width)
        here, *colours = planes[:, y - y0, x - x0]
        at = here > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.full(at.sum(), image, np.int64)), *(pa.array(v[at].astype(np.int32)) for v in (y, x, *colours))], ["image_id", "y", "x", "l", "a", "b"])

    return T.on_tiles(blocks.join(asked, ["image_id", "tile"]), grid, look, "image_id long, y int, x int, l int, a int, b int", ("asked",))


def dominant_pair_of_blocks(boxes: DataFrame, blocks: DataFrame, grid: T.Grid, per_box: int = 400, limit: int = 36, apart: int = 900) -> DataFrame:
    """``dominant_pair`` of colours in blocks: a block samples all boxes that reach into it, and a sample travels as one number."""
    stride = f"greatest(1, cast(floor(sqrt(cast(w as double) * h / {per_box})) as int))"
    squares = lambda v, n, most: f"explode(sequence(greatest(0, {v} div {grid.side}), least({most}, ({v} + {n} - 1) div {grid.side})))"
    inside = boxes.where(f"x < {grid.width} and y < {grid.height} and x + w > 0 and y + h > 0")
    asking = inside.select("image_id", "x", "y", "w", "h", F.expr(squares("y", "h", grid.down - 1)).alias("ty")).select("*", F.expr(squares("x", "w", grid.across - 1)).alias("tx"))
    asked = asking.groupBy("image_id", F.expr(f"cast(ty * {grid.across} + tx as int)").alias("tile")).agg(F.collect_list(F.expr(f"array(cast(x as int), y, w, h, {stride})")).alias("asked"))

    def sample(image: int, tile: int, planes: np.ndarray, asked: list[list[int]]) -> Iterator[pa.RecordBatch]:
        y0, y1, x0, x1 = grid.region(tile)
        found = []
        for x, y, w, h, step in asked:
            sy = np.arange(y + max(0, -((y - y0) // step)) * step, min(y + h, y1), step)
            sx = np.arange(x + max(0, -((x - x0) // step)) * step, min(x + w, x1), step)
            if len(sy) and len(sx):
                here, l, a, b = planes[:, (sy - y0)[:, None], (sx - x0)[None, :]].astype(np.int64)
                number = (((sy[:, None] << 20) + sx[None, :]) << 24) + (l << 16) + (a << 8) + b
                found.append((x, y, w, h, number[here > 0]))
        found = [f for f in found if len(f[4])]
        if found:
            ends = np.cumsum([0, *(len(f[4]) for f in found)]).astype(np.int32)
            numbers = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f[4] for f in found])))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), image, np.int64)), *(pa.array([f[k] for f in found], pa.int32()) for k in range(4)), numbers], ["image_id", "x", "y", "w", "h", "v"])

    sampled = T.on_tiles(blocks.join(asked, ["image_id", "tile"]), grid, sample, "image_id long, x int, y int, w int, h int, v array<bigint>", ("asked",))
    whole = sampled.groupBy("image_id", "x", "y", "w", "h").agg(F.sort_array(F.flatten(F.collect_list("v"))).alias("v"))
    byte = lambda k: f"cast(shiftright(s, {k}) & 255 as int)"
    return _pair(whole.withColumn("v", F.expr(f"transform(v, s -> named_struct('l', {byte(16)}, 'a', {byte(8)}, 'b', {byte(0)}))")), limit, apart)


def pair_match(p: str, q: str, limit: int = 9) -> str:
    """Two colour pairs agree: a pair whose colours agree is one colour; one matches either of two; two match in either order."""
    d = lambda a, b: "(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "lab") + f" < {limit})"
    p1, p2, q1, q2 = f"{p}.primary", f"{p}.secondary", f"{q}.primary", f"{q}.secondary"
    one, other = d(p1, p2), d(q1, q2)
    either = f"({d(p1, q1)} or {d(p1, q2)})"
    return f"case when {one} and {other} then {d(p1, q1)} when {one} then {either} when {other} then ({d(p1, q1)} or {d(p2, q1)}) else (({d(p1, q1)} and {d(p2, q2)}) or ({d(p1, q2)} and {d(p2, q1)})) end"


def seas(pairs: DataFrame) -> DataFrame:
    """Boxes of an image grouped by colour pairs, in order of y, x, h, w: a box joins the first group whose founder matches; founder says whether it is one itself."""
    colour = "struct<l:int,a:int,b:int>"
    slim = pairs.select("image_id", F.struct("y", "x", "h", "w", *(F.struct(*(F.col(f"{c}.{k}").cast("int").alias(k) for k in "lab")).alias(c) for c in ("primary", "secondary"))).alias("v"))
    held = slim.groupBy("image_id").agg(F.sort_array(F.collect_list("v")).alias("v"))
    zero = f"named_struct('founders', cast(array() as array<struct<primary:{colour},secondary:{colour}>>), 'ids', cast(array() as array<int>), 'fresh', cast(array() as array<boolean>))"
    hit = f"cast(array_position(transform(acc.founders, f -> {pair_match('f', 'v')}), true) as int)"
    grown = "concat(acc.founders, array(named_struct('primary', v.primary, 'secondary', v.secondary)))"
    step = f"named_struct('founders', if({hit} > 0, acc.founders, {grown}), 'ids', concat(acc.ids, array(if({hit} > 0, {hit} - 1, size(acc.founders)))), 'fresh', concat(acc.fresh, array(not coalesce({hit} > 0, false))))"
    folded = held.select("image_id", "v", F.expr(f"aggregate(v, {zero}, (acc, v) -> {step})").alias("s"))
    return folded.select("image_id", F.posexplode("v").alias("k", "v"), "s").select("image_id", "v.x", "v.y", "v.w", "v.h", F.expr("s.ids[k]").alias("sea_id"), F.expr("s.fresh[k]").alias("founder"), F.expr("s.founders[s.ids[k]].primary").alias("primary"), F.expr("s.founders[s.ids[k]].secondary").alias("secondary"))
