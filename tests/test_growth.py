"""What grows with the tables: how often a step works out its parts, reads its edges, and what it deals."""

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from pageloom.operators import network as N, select as S

BASE = N.base_distance(800)
EDGES = "image_id long, src struct<x:int,y:int,w:int,h:int>, dst struct<x:int,y:int,w:int,h:int>"
BOXES = "image_id long, x int, y int, w int, h int, sea int, is_word boolean, line_id int"


def boxes(spark, n=300, seed=3):
    rnd = random.Random(seed)
    rows = [(1, rnd.randrange(200), rnd.randrange(200), rnd.choice((9, 12, 90)), rnd.choice((10, 12, 25)), 0, rnd.random() < 0.8) for _ in range(n)]
    return spark.createDataFrame([(*r, r[2] // 20 if r[6] else None) for r in rows], BOXES).distinct()


def plan(df, mode="extended"):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain(mode)
    return out.getvalue().lower()


def marked(spark):
    """Edges that can be told in a plan by a number."""
    return N.pairwise(boxes(spark), BASE).where("src.x <> 987654321")


@pytest.mark.parametrize("pairs", [lambda b: N.pairwise(b, BASE), lambda b: N.aligned_series(b, BASE, BASE)])
def test_a_distance_is_worked_out_once_a_pair(spark, pairs):
    text = plan(pairs(boxes(spark)))
    assert text[text.index("optimized logical plan") : text.index("physical plan")].count("sqrt") == 1


@pytest.mark.parametrize("of", [lambda e, b: N.bridges(e, b, BASE), N.paragraph_cuts])
def test_edges_are_worked_out_once(spark, of):
    text = plan(of(marked(spark), boxes(spark)), "simple")
    assert text.count("987654321") == 0


def test_outliers_deal_the_edges_once(spark):
    edges = spark.createDataFrame([(1, (0, 0, 9, 9), (k, 0, 10, 10)) for k in range(5)] + [(1, (0, 0, 9, 9), (5, 0, 90, 90)), (2, (0, 0, 9, 9), (5, 0, 90, 90))], EDGES)
    found = N.outliers(edges)
    assert plan(found, "simple").count("exchange hashpartitioning") == 1
    assert [(r["image_id"], tuple(r["dst"])) for r in found.collect()] == [(1, (5, 0, 90, 90))]


@pytest.mark.parametrize("areas", [[1, 2, 3, 25], [1, 2, 3, 4, 25], [0, 0, 0, 9], [2, 2, 4, 24, 25], [1, 1, 1], [1, 1, 9, 9, 73, 73]])
def test_outliers_by_the_averaged_median(spark, areas):
    from statistics import median

    edges = spark.createDataFrame([(1, (0, 0, 9, 9), (k, 0, a, 1)) for k, a in enumerate(areas)], EDGES)
    m = median(areas)
    want = sorted(k for k, a in enumerate(areas) if len(areas) >= 4 and m > 0 and a > 8 * m)
    assert sorted(r["dst"]["x"] for r in N.outliers(edges).collect()) == want


def test_edges_are_dealt_by_size_first(spark):
    """Edges that can't be meant by their sizes aren't dealt by their ends."""
    edges = spark.createDataFrame([(1, (0, 0, 9, 9), (k, 0, 10, 10)) for k in range(5)], EDGES)
    assert re.search(r"src#\d+\.h\b", plan(N.body_to_heading(edges, boxes(spark))))
    assert "limit#" in plan(N.large_box_edges(edges, boxes(spark)))


def test_both_ways_reads_once(spark):
    assert plan(N.link(spark.range(3).select(F.col("id").alias("image_id"), F.expr("struct(1 as x, 2 as y, 3 as w, 4 as h)").alias("src"), F.expr("struct(2 as x, 2 as y, 3 as w, cast(id as int) as h)").alias("dst"))), "simple").count("range (") == 1


def test_nearest_deals_boxes_of_asked_images_only(spark):
    rnd = random.Random(8)
    held = [(i, rnd.randrange(1200), rnd.randrange(800), rnd.randrange(1, 60), rnd.randrange(1, 60)) for i in range(6) for _ in range(40 if i != 3 else 1)]
    asked = [(i, 100 * i + k, rnd.randrange(-300, 1500), rnd.randrange(-300, 1100)) for i in (1, 3, 5, 9) for k in range(30)]
    events = spark.createDataFrame(asked, "image_id long, event_id long, px int, py int")
    found = S.nearest(events, spark.createDataFrame(held, "image_id long, x int, y int, w int, h int"))
    folder = [f for f in spark.sparkContext._pageloom_runs if "-nearest-" in f][-1]
    assert {r["image_id"] for r in spark.read.parquet(f"{folder}/cells").select("image_id").distinct().collect()} == {1, 3, 5}

    def gap2(px, py, x, y, w, h):
        if x <= px <= x + w and y <= py <= y + h:
            return min(px - x, x + w - px, py - y, y + h - py) ** 2
        return max(x - px, 0, px - x - w) ** 2 + max(y - py, 0, py - y - h) ** 2

    want = {}
    for i, e, px, py in asked:
        near = [(-gap2(px, py, x, y, w, h), y, x, h, w) for j, x, y, w, h in held if j == i]
        if near:
            g, y, x, h, w = max(near)
            want[e] = (-g, x, y, w, h)
    assert {r["event_id"]: tuple(r)[1:] for r in found.collect()} == want


def test_pages_meet_their_squares_before_they_are_pixels(spark, tmp_path):
    from pageloom import fixtures as X, registry as R

    rnd = random.Random(2)
    vectors = [(k, [rnd.uniform(-0.7, 0.7) for _ in range(n)]) for k, n in [*((k, 64) for k in range(-9, 150)), (200, 130), (201, 5), (202, 0)]]
    vectors += [(300, [None, *[0.4] * 63]), (301, None), (None, [0.1] * 64)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = R._frames(spark, str(tmp_path))
    text = plan(got, "simple")
    assert text.index("generate posexplode") < text.index("join")
    want = spark.sql(R._PAGE.format(div="div", pixels="{pixels}", tiles="{tiles}"), pixels=X.pixels(spark, str(tmp_path)), tiles=R._tiles(spark, str(tmp_path)))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
