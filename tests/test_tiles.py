"""Tiled stencils and labels against the window queries and a flood fill, over tiles of many sizes."""

import numpy as np
import pytest

from pageloom import fixtures as X
from pageloom.operators import pixels as P, tiles as T

SF = "/root/testdata/sf0.001"


def table(df, *columns):
    return df.select("image_id", "y", "x", *columns).toPandas().sort_values(["image_id", "y", "x"]).to_numpy().tolist()


@pytest.fixture(scope="module")
def plane(spark, tmp_path_factory):
    """Two images of 41 x 29 places, the second only in part."""
    rnd = np.random.default_rng(2)
    data = [(k << 40, y, x, int(rnd.choice([20, 60, 200, 250]))) for k in (1, 2) for y in range(29) for x in range(41) if k == 1 or y < 6]
    path = str(tmp_path_factory.mktemp("plane"))
    spark.createDataFrame(data, "image_id long, y int, x int, v int").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("side", [8, 13, 512])
def test_stencils(spark, plane, side):
    held = P.dense(plane, 41, 29)
    grid = lambda h: T.Grid(41, 29, side, (h, h))
    of = lambda h, kernel, name: table(T.places_of(T.tiles_of_pixels(plane, grid(h), every=True), grid(h), kernel, name), name)
    slopes = P.gradients(held)
    assert of(1, lambda p: T.sobel(p[0])[2], "mag") == table(slopes, "mag")
    assert of(2, lambda p: T.thinned(p[0]), "nms") == table(P.thin(slopes), "nms")
    assert of(2, lambda p: T.dilated(p[0], 4, 3), "v") == table(P.dilate(held, 4, 3), "v")
    assert of(4, lambda p: T.closed(p[0], 5, 3), "v") == table(P.close(held, 5, 3), "v")


@pytest.mark.parametrize("side", [6, 512])
def test_edges(spark, plane, side):
    edges = T.Edges(T.Grid(41, 29, side), 200, 254)
    got = table(edges.places(T.tiles_of_pixels(plane, edges.grid)))
    assert got == table(P.canny(P.dense(plane, 41, 29), 200, 254)) and got


def flood(mask):
    left, found = {*zip(*np.nonzero(mask))}, []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            y, x = todo.pop()
            seen.append((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        found.append(sorted(map(tuple, np.array(seen).tolist())))
    return sorted(found)


def test_label_runs():
    rnd = np.random.default_rng(7)
    for density in (0.1, 0.4, 0.5, 0.9):
        for shape in ((1, 1), (1, 30), (30, 1), (17, 23)):
            mask = rnd.random(shape) < density
            labels, boxes = T.label_runs(mask)
            want = flood(mask)
            got = sorted(sorted(map(tuple, np.argwhere(labels == k).tolist())) for k in range(len(boxes)))
            assert got == want and (labels >= 0).sum() == mask.sum()
            for k, (x0, y0, x1, y1) in enumerate(boxes):
                y, x = np.nonzero(labels == k)
                assert (x.min(), y.min(), x.max(), y.max()) == (x0, y0, x1, y1)


@pytest.mark.parametrize("side", [5, 9])
def test_component_over_many_tiles(spark, side):
    """A spiral through all tiles, a ring around a dot, and corners that touch where four tiles meet."""
    mask = np.zeros((45, 45), bool)
    low, high = 0, 44
    while low < high:
        mask[low, low : high + 1] = mask[low : high + 1, high] = mask[high, low + 2 : high + 1] = mask[low + 2 : high + 1, low + 2] = True
        low, high = low + 4, high - 4
    other = np.zeros((45, 45), bool)
    other[10:21, 10] = other[10:21, 20] = other[10, 10:21] = other[20, 10:21] = other[15, 15] = True
    other[[4, 5], [4, 5]] = other[[8, 9], [9, 8]] = True
    data = [(k, int(y), int(x), 1) for k, m in ((1, mask), (2, other)) for y, x in zip(*np.nonzero(m))]
    pixels = spark.createDataFrame(data, "image_id long, y int, x int, v int")
    grid = T.Grid(45, 45, side, (1, 1))
    _, labels = T.mask_components(T.tiles_of_pixels(pixels, grid), grid, lambda p: p[0])
    got = sorted((r["image_id"], r["x"], r["y"], r["w"], r["h"]) for r in T.component_boxes(labels).collect())
    want = []
    for k, m in ((1, mask), (2, other)):
        for places in flood(m):
            (y0, y1), (x0, x1) = ((min(v), max(v)) for v in zip(*places))
            want.append((k, x0, y0, x1 - x0 + 1, y1 - y0 + 1))
    assert got == sorted(want) and (1, 0, 0, 45, 45) in got


def test_frames_and_pixels_give_the_same_tiles(spark, tmp_path):
    from pageloom.sources.frames import frame_pixels, png, read_frames

    rnd = np.random.default_rng(3)
    for k in range(2):
        (tmp_path / f"{k}.png").write_bytes(png(rnd.integers(0, 256, (20, 33, 3)).astype(np.uint8)))
    frames = read_frames(spark, str(tmp_path))
    grid = T.Grid(33, 20, 8, (3, 2))
    key = lambda df: sorted((r["image_id"], r["tile"], bytes(r["planes"])) for r in df.collect())
    assert key(T.tiles_of_frames(frames, grid)) == key(T.tiles_of_pixels(frame_pixels(frames), grid, ("r", "g", "b")))


def test_lightness_equals_the_expression(spark):
    rgb = np.random.default_rng(5).integers(0, 256, (3, 3000)).astype(np.uint8)
    rows = spark.createDataFrame([(1, 0, k, *map(int, v)) for k, v in enumerate(rgb.T)], "image_id long, y int, x int, r int, g int, b int")
    want = P.to_lab(rows).toPandas().sort_values("x")["lab_l"].to_numpy()
    assert (T.lightness(rgb) == want).all()


def test_empty_tables(spark, plane):
    edges = T.Edges(T.Grid(41, 29, 8), 3, 40, (3, 2))
    none = plane.where("false")
    assert edges.boxes(T.tiles_of_pixels(none, edges.grid)).count() == 0 and edges.places(T.tiles_of_pixels(none, edges.grid)).count() == 0
