"""Colours that blocks hand out against the joins with a row a pixel."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import colour as C, tiles as T

WIDTH, HEIGHT = 90, 70


@pytest.fixture(scope="module")
def plane(spark, tmp_path_factory):
    """Two images, the second with holes and places without a colour."""
    rnd = random.Random(4)
    rows = [(k, y, x, rnd.choice([20, 24, 200]), rnd.choice([128, 90]), 120) for k in (1, 2) for y in range(HEIGHT) for x in range(WIDTH) if k == 1 or rnd.random() < 0.6]
    path = str(tmp_path_factory.mktemp("colours"))
    spark.createDataFrame(rows, "image_id long, y int, x int, l int, a int, b int").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def boxes(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice((1, 2, 3)), rnd.randrange(-5, 80), rnd.randrange(-5, 60), rnd.randrange(1, 60), rnd.randrange(1, 50)) for _ in range(40)] + [(1, 0, 0, WIDTH, HEIGHT), (2, 200, 10, 5, 5)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, w int, h int").distinct()


def rows(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("side", [16, 64])
def test_dominant_pairs(spark, plane, boxes, side):
    grid = T.Grid(WIDTH, HEIGHT, side)
    columns = ["image_id", "x", "y", "w", "h", "primary.l", "primary.a", "primary.b", "primary.n", "secondary.l", "secondary.a", "secondary.b", "secondary.n"]
    columns = [F.col(c).cast("long").alias(c.replace(".", "_")) for c in columns]
    found = C.dominant_pair_of_blocks(boxes, C.colour_blocks(plane, grid), grid, per_box=50)
    got = rows(found, columns)
    assert got and got == rows(C.dominant_pair(boxes, plane, per_box=50), columns)


def test_samples_around_boxes(spark, plane, boxes):
    grid = T.Grid(WIDTH, HEIGHT, 16)
    places = C.perimeter(boxes, 2, 3)
    got = C.colours_at(places, C.colour_blocks(plane, grid), grid)
    want = places.select("image_id", "y", "x").distinct().join(plane, ["image_id", "y", "x"])
    columns = ["image_id", "y", "x", "l", "a", "b"]
    assert rows(got, columns) == rows(want, columns) and got.count()


def test_no_row_a_pixel_is_joined(spark, plane, boxes):
    """Blocks are joined by image and tile, not by place."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        grid = T.Grid(WIDTH, HEIGHT, 64)
        C.dominant_pair_of_blocks(boxes, C.colour_blocks(plane, grid), grid).explain("simple")
    assert not any(k in out.getvalue() for k in ("sy#", "sx#"))
