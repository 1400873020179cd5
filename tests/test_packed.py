"""Pixels travel as bytes: rows of a tile that are read together are one row of the shuffle."""

import contextlib
import io

import numpy as np

from pageloom.operators import tiles as T


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue().lower()


def test_pixels_are_packed_before_the_shuffle(spark):
    pixels = spark.range(5000).selectExpr("id div 1000 as image_id", "cast(id % 1000 div 40 as int) as y", "cast(id % 40 as int) as x", "cast(id % 251 as int) as v")
    grid = T.Grid(40, 25, 16, (2, 3))
    text = plan(T.tiles_of_pixels(pixels, grid))
    assert "generate" not in text and text.index("exchange hashpartitioning(image_id") < text.index("mapinarrow")
    tiles = T.tiles_of_pixels(pixels, grid).collect()
    assert len(tiles) == 5 * 6
    plane = (np.arange(5000) % 251).reshape(5, 25, 40)
    for r in tiles:
        y0, y1, x0, x1 = grid.region(r["tile"])
        assert (np.frombuffer(r["planes"], np.uint8).reshape(y1 - y0, x1 - x0) == plane[r["image_id"], y0:y1, x0:x1]).all()


def test_packed_rows_with_nulls_and_places_outside(spark):
    rows = [(None, 0, 0, 7, 1), (0, 0, 0, 9, 2), (None, 3, 3, 8, None), (0, 9, 9, 5, 5), (0, -1, 0, 5, 5), (0, None, 0, 5, 5), (4, 2, 2, None, 3)]
    pixels = spark.createDataFrame(rows, "image_id long, y int, x int, a int, b int").coalesce(1)
    grid = T.Grid(4, 4, 3, (1, 1))
    got = {(r["image_id"], r["tile"]): np.frombuffer(r["planes"], np.uint8) for r in T.tiles_of_pixels(pixels, grid, ("a", "b")).collect()}
    want = {}
    for image, y, x, *values in rows:
        for tile in range(4):
            y0, y1, x0, x1 = grid.region(tile)
            if y is not None and y0 <= y < y1 and x0 <= x < x1:
                planes = want.setdefault((image, tile), np.zeros((2, y1 - y0, x1 - x0), np.uint8))
                planes[:, y - y0, x - x0] = [v or 0 for v in values]
    assert got.keys() == want.keys() and all((got[k] == want[k].ravel()).all() for k in want)
