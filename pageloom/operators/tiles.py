"""Frames cut into tiles with halo rows: stencils, closing and labelling on whole arrays, a row a tile.

A tile's region is its core of ``side`` x ``side`` places and as many places around it as a
kernel needs, clipped at the frame. So a kernel works on one region with array operations,
what it makes is right inside the core, and no task holds more than a region.

Labels are found inside a region by union-find over runs of a row. Regions overlap, so a place
near a core's border is labelled by several tiles; only these places are shuffled, and only the
labels that meet there go through the star joins of ``plans.components``.

Missing places are 0. Values are bytes. Numbers in ``tile`` count the cores by rows. A frame
without a place inside a tile's region has no row for that tile unless ``every`` asks for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.plans.components import connected_components
from pageloom.runtime import Scratch, ship

SIDE = 512
TILE = "image_id long, tile int, planes binary"
PLACES = "image_id long, y int, x int"
#: A label of a tile, as one number of its image.
NODE = "cast(tile as bigint) * 4294967296 + {0}"


@dataclass(frozen=True)
class Grid:
    """The tiles of frames of one size; halo is (rows, columns) around a core."""

    width: int
    height: int
    side: int = SIDE
    halo: tuple[int, int] = (0, 0)

    @property
    def across(self) -> int:
        return -(-self.width // self.side)

    @property
    def down(self) -> int:
        return -(-self.height // self.side)

    def region(self, tile: int, halo: tuple[int, int] | None = None) -> tuple[int, int, int, int]:
        """y0, y1, x0, x1 of a tile's core grown by a halo, inside the frame."""
        hy, hx = self.halo if halo is None else halo
        y, x = tile // self.across * self.side, tile % self.across * self.side
        return max(0, y - hy), min(self.height, y + self.side + hy), max(0, x - hx), min(self.width, x + self.side + hx)

    def cut(self, plane: np.ndarray, tile: int, halo: tuple[int, int]) -> np.ndarray:
        """The part of an array over the own halo that a smaller halo covers."""
        y0, _, x0, _ = self.region(tile)
        a0, a1, b0, b1 = self.region(tile, halo)
        return plane[..., a0 - y0 : a1 - y0, b0 - x0 : b1 - x0]

    def band(self, tile: int, halo: tuple[int, int]) -> np.ndarray:
        """Over the region of a halo: whether a place lies in another tile's region too."""
        y0, y1, x0, x1 = self.region(tile, halo)
        cy0, cy1, cx0, cx1 = self.region(tile, (0, 0))
        y, x = np.arange(y0, y1), np.arange(x0, x1)
        near = lambda v, low, high, h, end: ((v < low + h) & (low > 0)) | ((v >= high - h) & (high < end))
        return near(y, cy0, cy1, halo[0], self.height)[:, None] | near(x, cx0, cx1, halo[1], self.width)[None, :]

    def with_halo(self, hy: int, hx: int) -> Grid:
        return Grid(self.width, self.height, self.side, (hy, hx))


# ---- tiles from pixels and from frames ---------------------------------------


def _bytes(rows: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary a group: the bytes of the rows between its bounds."""
    width = rows.dtype.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _pack(batch: pa.RecordBatch, grid: Grid, columns: tuple[str, ...]) -> pa.RecordBatch:
    """A row (image_id, tile, at, held) for each tile that rows of ``batch`` belong to: where they are in its region, and their values."""
    (hy, hx), side = grid.halo, grid.side
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    unknown = column("image_id").is_null().to_numpy(zero_copy_only=False)
    image, y, x = column("image_id").fill_null(0).to_numpy(), column("y").to_numpy().astype(np.int64), column("x").to_numpy().astype(np.int64)
    held = np.stack([column(c).fill_null(0).to_numpy().astype(np.uint8) for c in columns], axis=1)
    first_y, first_x = np.maximum(0, (y - hy) // side), np.maximum(0, (x - hx) // side)
    many_x = np.minimum(grid.across - 1, (x + hx) // side) - first_x + 1
    many = many_x * (np.minimum(grid.down - 1, (y + hy) // side) - first_y + 1)
    row = np.repeat(np.arange(len(y)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    ty, tx = first_y[row] + k // many_x[row], first_x[row] + k % many_x[row]
    left = np.maximum(0, tx * side - hx)
    at = (y[row] - np.maximum(0, ty * side - hy)) * (np.minimum(grid.width, (tx + 1) * side + hx) - left) + x[row] - left
    tile = ty * grid.across + tx
    order = np.lexsort((tile, image[row], unknown[row]))
    row, tile, at = row[order], tile[order], at[order]
    image, unknown = image[row], unknown[row]
    first = np.ones(len(row), bool)
    first[1:] = (tile[1:] != tile[:-1]) | (image[1:] != image[:-1]) | (unknown[1:] != unknown[:-1])
    first = np.flatnonzero(first)
    bounds = np.append(first, len(row))
    return pa.RecordBatch.from_arrays(
        [pa.array(image[first], pa.int64(), mask=unknown[first]), pa.array(tile[first].astype(np.int32)), _bytes(at.astype(np.int32), bounds), _bytes(held[row], bounds)], ["image_id", "tile", "at", "held"]
    )


def tiles_of_pixels(pixels: DataFrame, grid: Grid, columns: tuple[str, ...] = ("v",), every: bool = False) -> DataFrame:
    """Tiles of rows (image_id, y, x, columns): one shuffle, in which a place near a core's border goes to each tile that needs it.

    Rows are packed before it: places of a tile that are read together travel and are sorted as one row of bytes.
    """
    ship(pixels.sparkSession)
    places = pixels.select(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *(F.col(c).cast("short").alias(c) for c in columns))
    places = places.where(f"y >= 0 and y < {grid.height} and x >= 0 and x < {grid.width}")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _pack(batch, grid, columns)

    dealt = places.mapInArrow(pack, "image_id long, tile int, at binary, held binary")
    if every:
        empty = pixels.select(F.col("image_id").cast("long").alias("image_id")).distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(grid.down * grid.across - 1))).alias("tile"))
        dealt = dealt.unionByName(empty, allowMissingColumns=True)

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        tile = key[1].as_py()
        y0, y1, x0, x1 = grid.region(tile)
        planes = np.zeros((len(columns), (y1 - y0) * (x1 - x0)), np.uint8)
        for at, held in zip(table["at"], table["held"]):
            if at.is_valid:
                planes[:, np.frombuffer(at.as_buffer(), np.int32)] = np.frombuffer(held.as_buffer(), np.uint8).reshape(-1, len(columns)).T
        return pa.table({"image_id": pa.array([key[0].as_py()], pa.int64()), "tile": pa.array([tile], pa.int32()), "planes": pa.array([planes.tobytes()], pa.binary())})

    return dealt.groupBy("image_id", "tile").applyInArrow(gather, TILE)


def tiles_of_frames(frames: DataFrame, grid: Grid) -> DataFrame:
    """Tiles (r, g, b planes) of frames (image_id, channels, data) of the grid's size, cut where the frame is read."""
    ship(frames.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, channels, data in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("image_id", "channels", "data"))):
                n = channels.as_py()
                plane = np.frombuffer(data.as_buffer(), np.uint8).reshape(grid.height, grid.width, n)
                plane = np.moveaxis(plane[..., [2, 1, 0] if n >= 3 else [0, 0, 0]], 2, 0)
                for tile in range(grid.down * grid.across):
                    y0, y1, x0, x1 = grid.region(tile)
                    yield pa.RecordBatch.from_arrays([pa.array([image.as_py()], pa.int64()), pa.array([tile], pa.int32()), pa.array([plane[:, y0:y1, x0:x1].tobytes()], pa.binary())], ["image_id", "tile", "planes"])

    return frames.select("image_id", "channels", "data").mapInArrow(cut, TILE)


def on_tiles(tiles: DataFrame, grid: Grid, kernel: Callable, schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``kernel(image_id, tile, planes, *more)`` yields Arrow batches of ``schema`` for each tile; planes is (channels, rows, columns)."""
    ship(tiles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("image_id", "tile", "planes", *more)]
            for k in range(batch.num_rows):
                image, tile = columns[0][k].as_py(), columns[1][k].as_py()
                y0, y1, x0, x1 = grid.region(tile)
                yield from kernel(image, tile, np.frombuffer(columns[2][k].as_buffer(), np.uint8).reshape(-1, y1 - y0, x1 - x0), *(c[k].as_py() for c in columns[3:]))

    return tiles.select("image_id", "tile", "planes", *more).mapInArrow(run, schema)


def _rows(image: int, y: np.ndarray, x: np.ndarray, **values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(y), image, np.int64)), *(pa.array(v.astype(np.int32)) for v in (y, x)), *(pa.array(v.astype(np.int32)) for v in values.values())], ["image_id", "y", "x", *values]
    )


def places_of(tiles: DataFrame, grid: Grid, kernel: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """A row (image_id, y, x, name) for each place of every core, of the plane that ``kernel`` makes of a region's planes."""

    def spread(image, tile, planes):
        y0, y1, x0, x1 = grid.region(tile, (0, 0))
        core = grid.cut(kernel(planes), tile, (0, 0))
        y, x = np.divmod(np.arange(core.size), x1 - x0)
        yield _rows(image, y + y0, x + x0, **{name: core.ravel()})

    return on_tiles(tiles, grid, spread, f"{PLACES}, {name} int")


# ---- kernels -----------------------------------------------------------------


def _pad(plane: np.ndarray) -> np.ndarray:
    return np.pad(plane, 1)


def sobel(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gx, gy and the saturated magnitude; the array's border is 0 in all three."""
    p = plane.astype(np.int32)
    gx, gy, mag = (np.zeros(p.shape, np.int32) for _ in range(3))
    if min(p.shape) >= 3:
        dx, sx = p[:, 2:] - p[:, :-2], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
        gx[1:-1, 1:-1] = dx[:-2] + 2 * dx[1:-1] + dx[2:]
        gy[1:-1, 1:-1] = sx[2:] - sx[:-2]
        mag[1:-1, 1:-1] = np.minimum(255, np.floor(np.sqrt((gx * gx + gy * gy)[1:-1, 1:-1].astype(float))))
    return gx, gy, mag


def thinned(plane: np.ndarray) -> np.ndarray:
    """Magnitudes that are ridges across their gradient's octant, else 0."""
    gx, gy, mag = sobel(plane)
    m, (h, w) = _pad(mag), mag.shape
    at = lambda dy, dx: m[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    flat, steep, falling = 5 * abs(gy) < 2 * abs(gx), 5 * abs(gx) < 2 * abs(gy), (gx > 0) == (gy > 0)
    choice = [flat, steep, falling]
    first = np.select(choice, [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    second = np.select(choice, [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    return np.where((mag > 0) & (mag > first) & (mag >= second), mag, 0)


def slid(plane: np.ndarray, k: int, axis: int, largest: bool) -> np.ndarray:
    """The largest or smallest value of a clipped window of 2 * (k // 2) + 1 along an axis, in log k steps."""
    half, pick = k // 2, np.maximum if largest else np.minimum
    out = np.moveaxis(np.pad(plane, [(half, half) if n == axis else (0, 0) for n in (0, 1)], constant_values=0 if largest else 255), axis, 0)
    have, want = 1, 2 * half + 1
    while have < want:
        step = min(have, want - have)
        out = pick(out[:-step], out[step:])
        have += step
    return np.moveaxis(out, 0, axis)


def dilated(plane: np.ndarray, kx: int, ky: int) -> np.ndarray:
    return slid(slid(plane, kx, 1, True), ky, 0, True)


def eroded(plane: np.ndarray, kx: int, ky: int) -> np.ndarray:
    return slid(slid(plane, kx, 1, False), ky, 0, False)


def closed(plane: np.ndarray, kx: int, ky: int) -> np.ndarray:
    return eroded(dilated(plane, kx, ky), kx, ky)


def lightness(rgb: np.ndarray) -> np.ndarray:
    """8-bit L of three planes; equals ``pixels.lab``."""
    level = np.arange(256) / 255.0
    linear = np.where(level <= 0.04045, level / 12.92, ((level + 0.055) / 1.055) ** 2.4)
    # fixed values: the middle row of the sRGB to XYZ matrix
    y = 0.2126729 * linear[rgb[0]] + 0.7151522 * linear[rgb[1]] + 0.0721750 * linear[rgb[2]]
    f = np.where(y > (6 / 29) ** 3, y ** (1 / 3), y / (3 * (6 / 29) ** 2) + 4 / 29)
    return np.clip(np.floor((116 * f - 16) * 255 / 100 + 0.5), 0, 255).astype(np.uint8)


def label_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels from 0 of 8-connected components, -1 elsewhere; boxes x0, y0, x1, y1 of each), by union-find over runs."""
    h, w = mask.shape
    change = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(change == 1)
    end = np.nonzero(change == -1)[1]
    n, key = len(row), w + 2
    labels = np.full((h, w), -1, np.int32)
    if not n:
        return labels, np.empty((0, 4), np.int64)
    # the runs of the row above that touch a run, corners included
    low = np.searchsorted(row * key + end, (row - 1) * key + start, side="left")
    high = np.searchsorted(row * key + start, (row - 1) * key + end, side="right")
    many = np.maximum(high - low, 0)
    a = np.repeat(np.arange(n), many)
    b = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    parent = np.arange(n)
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    number = np.cumsum(parent == np.arange(n)) - 1
    of_run = number[parent]
    size = end - start
    flat = np.repeat(row * w + start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    labels.ravel()[flat] = np.repeat(of_run, size)
    k = int(number[-1]) + 1
    boxes = np.stack([np.full(k, w), np.full(k, h), np.full(k, -1), np.full(k, -1)], axis=1)
    for column, value, pick in ((0, start, np.minimum), (1, row, np.minimum), (2, end - 1, np.maximum), (3, row, np.maximum)):
        pick.at(boxes[:, column], of_run, value)
    return labels, boxes


# ---- labels over all tiles -----------------------------------------------------

#: What a labelling step writes for a tile: its labels with a value and a box, and its labelled places that other tiles label too.
LABELLED = "image_id long, tile int, planes binary, labels array<struct<label:int,top:int,x:int,y:int,x1:int,y1:int>>, shared array<struct<y:int,x:int,label:int>>"


def _structs(**columns: np.ndarray) -> pa.Array:
    """One list that holds all rows."""
    rows = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)


def label_tile(image: int, tile: int, plane: np.ndarray, grid: Grid, halo: tuple[int, int]) -> pa.RecordBatch:
    """A row of LABELLED for the places above 0 of ``plane``, which covers the core grown by ``halo``."""
    y0, _, x0, _ = grid.region(tile, halo)
    labels, boxes = label_runs(plane > 0)
    top = np.zeros(len(boxes), np.int64)
    inside = labels >= 0
    np.maximum.at(top, labels[inside], plane[inside])
    y, x = np.nonzero(inside & grid.band(tile, halo))
    known = _structs(label=np.arange(len(boxes)), top=top, x=boxes[:, 0] + x0, y=boxes[:, 1] + y0, x1=boxes[:, 2] + x0, y1=boxes[:, 3] + y0)
    return pa.RecordBatch.from_arrays(
        [pa.array([image], pa.int64()), pa.array([tile], pa.int32()), pa.array([plane.astype(np.uint8).tobytes()], pa.binary()), known, _structs(y=y + y0, x=x + x0, label=labels[y, x])],
        ["image_id", "tile", "planes", "labels", "shared"],
    )


def join_labels(labelled: DataFrame) -> DataFrame:
    """image_id, tile, label, component (one number for all labels of a component of the image), top, x, y, x1, y1 of every label of ``labelled``, a written table."""
    shared = labelled.select("image_id", "tile", F.explode("shared").alias("s")).select("image_id", "s.y", "s.x", F.expr(NODE.format("s.label")).alias("node"))
    # a place has at most four labels
    met = shared.groupBy("image_id", "y", "x").agg(F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1)
    edges = met.select("image_id", F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).where("a <> b").distinct()
    found = connected_components(edges, keys=["image_id"])
    labels = labelled.select("image_id", "tile", F.explode("labels").alias("l")).select("image_id", "tile", "l.*").withColumn("node", F.expr(NODE.format("label")))
    return labels.join(found, ["image_id", "node"], "left").withColumn("component", F.coalesce("component", "node")).drop("node")


def strong_labels(joined: DataFrame, least: int) -> DataFrame:
    """image_id, tile, strong: labels of each tile whose component's top is ``least`` or more."""
    tops = joined.groupBy("image_id", "component").agg(F.max("top").alias("best")).where(f"best >= {least}").select("image_id", "component")
    return joined.select("image_id", "tile", "label", "component").join(tops, ["image_id", "component"], "left_semi").groupBy("image_id", "tile").agg(F.collect_list("label").alias("strong"))


def component_boxes(joined: DataFrame) -> DataFrame:
    """image_id, component, x, y, w, h"""
    grown = joined.groupBy("image_id", "component").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return grown.select("image_id", "component", "x", "y", F.expr("x1 - x + 1").alias("w"), F.expr("y1 - y + 1").alias("h"))


class Edges:
    """Canny edges of tiles, their closing and its component boxes.

    ``closing`` is the kernel (kx, ky) that later steps close with; halos are chosen for it.
    """

    def __init__(self, grid: Grid, low: int, high: int, closing: tuple[int, int] | None = None):
        kx, ky = closing or (1, 1)
        # a closing reaches 2 * (k // 2) places; components are tied by one more
        self.reach = (2 * (ky // 2) + 1, 2 * (kx // 2) + 1)
        self.grid = grid.with_halo(self.reach[0] + 2, self.reach[1] + 2)
        self.low, self.high, self.closing = low, high, closing

    def weak(self, tiles: DataFrame, scratch: Scratch) -> DataFrame:
        """LABELLED rows of the ridges of at least ``low``, over cores grown by ``reach``. Planes are one of values, or r, g and b."""
        grid, reach, low = self.grid, self.reach, self.low

        def find(image, tile, planes):
            ridges = grid.cut(thinned(lightness(planes) if len(planes) == 3 else planes[0]), tile, reach)
            yield label_tile(image, tile, np.where(ridges >= low, ridges, 0), grid, reach)

        return scratch.save(on_tiles(tiles, grid, find, LABELLED), "weak")

    def masks(self, tiles: DataFrame, scratch: Scratch) -> DataFrame:
        """Tiles over cores grown by ``reach``: weak planes, and ``strong``, the labels whose component reaches ``high``."""
        weak = self.weak(tiles, scratch)
        return weak.select("image_id", "tile", "planes").join(strong_labels(join_labels(weak), self.high), ["image_id", "tile"])

    @staticmethod
    def _mask(plane: np.ndarray, strong: list[int]) -> np.ndarray:
        labels, boxes = label_runs(plane > 0)
        kept = np.zeros(len(boxes) + 1, np.uint8)
        kept[strong] = 255
        return kept[labels]

    def places(self, tiles: DataFrame) -> DataFrame:
        """image_id, y, x of the edges."""
        grid, mask = self.grid.with_halo(*self.reach), self._mask

        def spread(image, tile, planes, strong):
            y0, _, x0, _ = grid.region(tile, (0, 0))
            y, x = np.nonzero(grid.cut(mask(planes[0], strong), tile, (0, 0)))
            yield _rows(image, y + y0, x + x0)

        return on_tiles(self.masks(tiles, Scratch(tiles.sparkSession, "edges")), grid, spread, PLACES, ("strong",))

    def boxes(self, tiles: DataFrame) -> DataFrame:
        """image_id, component, x, y, w, h of the components of the closed edges."""
        grid, mask, (kx, ky) = self.grid.with_halo(*self.reach), self._mask, self.closing or (1, 1)
        scratch = Scratch(tiles.sparkSession, "edges")

        def close(image, tile, planes, strong):
            yield label_tile(image, tile, grid.cut(closed(mask(planes[0], strong), kx, ky), tile, (1, 1)), grid, (1, 1))

        return component_boxes(join_labels(scratch.save(on_tiles(self.masks(tiles, scratch), grid, close, LABELLED, ("strong",)), "closed")))


def mask_components(tiles: DataFrame, grid: Grid, mask: Callable[[np.ndarray], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """(LABELLED rows over cores grown by one place, their joined labels) of the places where ``mask(planes)`` is above 0."""

    def label(image, tile, planes):
        yield label_tile(image, tile, grid.cut(mask(planes), tile, (1, 1)), grid, (1, 1))

    labelled = Scratch(tiles.sparkSession, "mask").save(on_tiles(tiles, grid, label, LABELLED), "labelled")
    return labelled, join_labels(labelled)
