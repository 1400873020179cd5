"""Strongly connected components, clusters and nearest boxes against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import network as N, select as S


def led_to(edges, start):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for b in edges.get(at, ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def table(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    return out


ring = lambda nodes: list(zip(nodes, [*nodes[1:], nodes[0]]))
GRAPHS = {
    "rings": ring([5, 9, 2, 7]) + ring([1, 3, 8]) + [(7, 3), (8, 20), (20, 21), (40, 5)],
    "nested": ring([1, 2, 3, 4, 5, 6]) + ring([3, 10, 11]) + [(6, 30), (30, 31), (31, 30), (31, 32)] + ring([50, 51, 52, 53]) + [(53, 1), (4, 60)],
    "mutual": [(1, 2), (2, 1), (2, 3), (3, 2), (3, 9), (9, 10), (7, 7)],
    "path": [(k, k + 1) for k in range(6)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_strong_components(spark, name):
    pairs = GRAPHS[name]
    nodes, to = {n for p in pairs for n in p}, table(pairs)
    want = {n: min(m for m in nodes if m in led_to(to, n) and n in led_to(to, m)) for n in nodes}
    got = {r["node"]: r["component"] for r in N.strong_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


def test_random_graph(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(46)]
    nodes, to = {n for p in pairs for n in p}, table(pairs)
    want = {n: min(m for m in nodes if m in led_to(to, n) and n in led_to(to, m)) for n in nodes}
    assert {r["node"]: r["component"] for r in N.strong_components(spark.createDataFrame(pairs, "a long, b long")).collect()} == want


def box(k):
    return (k % 97, k // 97, 3, 3)


SCHEMA = "image_id long, src struct<x:int,y:int,w:int,h:int>, dst struct<x:int,y:int,w:int,h:int>"


def test_clusters(spark):
    rnd = random.Random(6)
    pairs = [(i, rnd.randrange(25), rnd.randrange(25)) for i in (1, 2) for _ in range(26)]
    edges = spark.createDataFrame([(i, box(a), box(b)) for i, a, b in pairs], SCHEMA)
    starts = spark.createDataFrame([(i, box(k)) for i in (1, 2) for k in (0, 3, 7, 24, 500)], "image_id long, box struct<x:int,y:int,w:int,h:int>")
    of, members = N.clusters(edges, starts)
    got = {(r["image_id"], tuple(r["box"])): [tuple(m) for m in r["members"]] for r in of.join(members, "cluster").collect()}
    want = {(i, box(k)): sorted(box(n) for n in led_to(table([(a, b) for j, a, b in pairs if j == i]), k)) for i in (1, 2) for k in (0, 3, 7, 24, 500)}
    assert got == want


def test_a_large_component_is_stored_once(spark):
    """A component of 10,000 boxes, all of them starts: rows by the boxes, not by their pairs."""
    n = 10_000
    both = [(1, box(k), box(k + 1)) for k in range(n - 1)] + [(1, box(k + 1), box(k)) for k in range(n - 1)]
    edges = spark.createDataFrame(both, SCHEMA)
    of, members = N.clusters(edges, edges.select("image_id", F.col("src").alias("box")))
    assert of.count() == n and of.select("cluster").distinct().count() == 1
    assert [len(r["members"]) for r in members.collect()] == [n]


@pytest.mark.parametrize("cell", [7, 64])
def test_nearest_by_rings(spark, cell):
    """Boxes of all sizes, points far outside, inside large boxes and with ties, and images without boxes."""
    rnd = random.Random(cell)
    boxes = [(i, rnd.randint(-50, 900), rnd.randint(0, 700), rnd.choice([1, 5, 40, 300]), rnd.choice([1, 8, 200])) for i in (1, 2) for _ in range(30)]
    boxes += [(3, 10, 10, 4, 4), (3, 30, 10, 4, 4), (3, 10, 30, 4, 4), (3, 10, 10, 4, 4), (5, 0, 0, 2000, 2000)]
    events = [(k, rnd.choice([1, 2, 4]), rnd.randint(-200, 1500), rnd.randint(-900, 1800)) for k in range(120)] + [(500, 3, 22, 12), (501, 3, 22, 22), (502, 5, 1000, 1000), (503, 3, -4000, 5000)]

    def gap2(px, py, b):
        _, x, y, w, h = b
        if x <= px <= x + w and y <= py <= y + h:
            return min(px - x, x + w - px, py - y, y + h - py) ** 2
        return max(x - px, 0, px - x - w) ** 2 + max(y - py, 0, py - y - h) ** 2

    want = {}
    for k, i, px, py in events:
        near = [(-gap2(px, py, b), b[2], b[1], b[4], b[3]) for b in boxes if b[0] == i]
        if near:
            g, y, x, h, w = max(near)
            want[k] = (-g, x, y, w, h)
    got = S.nearest(spark.createDataFrame(events, "event_id long, image_id long, px int, py int"), spark.createDataFrame(boxes, "image_id long, x int, y int, w int, h int"), cell).collect()
    assert {r["event_id"]: (r["gap2"], r["x"], r["y"], r["w"], r["h"]) for r in got} == want and len(got) == len(want)


def levels(pairs, starts):
    """start, node, depth, parent by plain loops."""
    to, out = table(pairs), set()
    for s in starts:
        depth, front, k = {s: 0}, [s], 0
        out.add((s, s, 0, None))
        while front:
            k, led = k + 1, {}
            for a in front:
                for b in to.get(a, ()):
                    if b not in depth:
                        led[b] = min(a, led.get(b, a))
            out |= {(s, b, k, a) for b, a in led.items()}
            depth |= dict.fromkeys(led, k)
            front = list(led)
    return out


@pytest.mark.parametrize("most", [1 << 21, 12])
def test_reach_by_blocks(spark, monkeypatch, most):
    rnd = random.Random(6)
    pairs = [p for g in GRAPHS.values() for p in g] + [(rnd.randrange(-40, 90), rnd.randrange(-40, 90)) for _ in range(130)]
    starts = [*range(-45, 95), 1000, 5, 5]
    monkeypatch.setattr(N, "MARKS", 700)
    edges = spark.createDataFrame([*pairs, *pairs[:9], (None, 3), (4, None)], "a long, b long")
    got = [tuple(r) for r in N.reach_by_blocks(edges, spark.createDataFrame([(s,) for s in [*starts, None]], "start long"), bits=4, most=most).collect()]
    assert len(got) == len(set(got))
    assert set(got) == levels(pairs, set(starts)) | {(None, None, 0, None)}


def test_reach_by_blocks_deals_edges_not_pairs(spark):
    """Ways that meet are dealt once a block, so what is dealt is far less than the pairs."""
    orders = spark.range(4096)
    edges = orders.selectExpr("id as a", "id div 3 as b").union(orders.selectExpr("id", "id div 5"))
    found = N.reach_by_blocks(edges, orders.select(F.col("id").alias("start")), bits=8)
    folder = [f for f in spark.sparkContext._pageloom_runs if "-blocks-" in f][-1]
    assert 3 * spark.read.parquet(f"{folder}/edges[0-9]*").count() < found.count()
