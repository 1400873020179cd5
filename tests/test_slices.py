"""Tables that go slice after slice: whole results, and only one slice's files on disk."""

import contextlib
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from pageloom import registry, runtime
from pageloom.operators import network as N
from pageloom.runtime import Scratch, by_slices

SF = "/root/testdata/sf0.001"
BASE = N.base_distance(800)


def folders(base):
    return sorted(os.listdir(base.removeprefix("file://")))


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue().lower()


def slices_folder(spark):
    return [f for f in spark.sparkContext._pageloom_runs if "-slices-" in f][-1]


def test_a_key_is_in_one_slice_and_slices_end(spark):
    rows = spark.createDataFrame([(k % 7 if k % 7 else None, k) for k in range(40)], "image_id long, v long")
    names = spark.createDataFrame([(k, f"n{k}") for k in (1, 2, 3, 99, None)], "image_id long, name string")
    at_work = []

    def of(rows, names):
        rows = Scratch(spark, "inner").save(rows, "rows")
        at_work.append([f for f in folders(slices_folder(spark)) if f.startswith("slice")])
        counts = rows.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
        return counts.join(names, "image_id", "left")

    whole = sorted(map(tuple, by_slices(of, rows, names).collect()), key=str)
    at_work.clear()
    got = by_slices(of, rows, names, most=2)
    assert sorted(map(tuple, got.collect()), key=str) == whole
    assert len(at_work) == 20 and all(f == [f"slice{k}"] for k, f in enumerate(at_work))
    assert folders(slices_folder(spark)) == sorted(f"found{k}" for k in range(20))


def test_few_rows_are_one_slice(spark):
    asked = []
    got = by_slices(lambda t: asked.append(t.count()) or t, spark.range(9).withColumnRenamed("id", "image_id"), most=9)
    assert asked == [9] and got.count() == 9
    empty = spark.range(0).withColumnRenamed("id", "image_id")
    assert by_slices(lambda t: t, empty, most=1).count() == 0


@pytest.mark.parametrize("name", ["a12_origin_counts", "n4_network", "j10_paragraph_cuts", "j11_body_to_heading"])
def test_queries_by_slices(spark, name, monkeypatch):
    whole = registry.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{slices_folder(spark)}/rows").count()
    monkeypatch.setattr(runtime, "SLICE", n // 2 + 1)
    got = registry.QUERIES[name](spark, SF)
    assert got.dtypes == whole.dtypes and whole.count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert folders(slices_folder(spark)) == ["found0", "found1"]


EDGE = "image_id", "src", "dst"


def mixed_boxes(spark, seed=5):
    """Boxes that are near each other, in columns of lines, also the same one in several groups, with and without a word, and twice."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(700):
        x, y = rnd.randrange(0, 260, 3), rnd.randrange(0, 260, 4)
        w, h = rnd.choice(((9, 12), (14, 12), (14, 22), (90, 40), (120, 60)))
        for _ in range(rnd.choice((1, 1, 2, 3))):
            word = w < 90 and rnd.random() < 0.8
            rows.append((rnd.randrange(3), x, y, w, h, rnd.choice((0, 1, 2, None)), word, y // 20 * 10 + x // 60 if word else None))
    return spark.createDataFrame(rows + rows[:50], "image_id long, x int, y int, w int, h int, sea int, is_word boolean, line_id int")


def held(rows):
    return sorted((r["image_id"], tuple(r["src"]), tuple(r["dst"])) for r in rows.select(*EDGE).collect())


def test_pairs_come_out_once_and_are_not_dealt(spark):
    rows = mixed_boxes(spark).distinct()
    got, boxes = held(N.pairwise(rows, BASE)), {}
    for r in rows.collect():
        if r["sea"] is not None:
            boxes.setdefault((r["image_id"], r["x"], r["y"], r["w"], r["h"]), set()).add(r["sea"])
    assert len(set(got)) == len(got) > 100
    assert any(len(boxes[i, *a] & boxes[i, *b]) > 1 for i, a, b in got) and all(boxes[i, *a] & boxes[i, *b] for i, a, b in got)
    one = rows.where("sea is not null").select("image_id", *N.BOX).distinct().withColumn("sea", F.lit(0))
    assert got == sorted({(i, a, b) for i, a, b in held(N.pairwise(one, BASE)) if boxes[i, *a] & boxes[i, *b]})
    for pairs in (N.pairwise(rows, BASE), N.pairs_to_heading(N.each_once(rows), BASE)):
        text = plan(pairs)
        assert "exchange" not in text[: text.index("join")] and "aggregate" not in text[: text.index("join")]


def test_pairs_know_before_they_meet(spark):
    rows = mixed_boxes(spark)
    once = rows.distinct()
    edges = N.pairwise(once, BASE)
    assert N.paragraph_cuts(edges, once).where("src.w < 90 and dst.w < 90").count()
    for got, want in ((N.pairs_to_heading(N.each_once(rows), BASE), N.body_to_heading(edges, once)), (N.pairs_across_paragraphs(N.each_once(rows), BASE), N.paragraph_cuts(edges, once))):
        assert held(got) == held(want) and 0 < want.count() < edges.count()
