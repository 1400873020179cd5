import duckdb
import numpy as np
import pandas as pd
import pytest

from pageloom import registry
from pageloom.functions import geometry as G
from pageloom.sources.frames import close_plane, png
from pageloom.streaming.sessions import START, step

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "NULL" if pd.isna(v) else v if isinstance(v, str) else round(float(v), 9)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "events", "documents", "orders"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = rows(registry.QUERIES[name](spark, SF).toPandas())
    assert got == rows(con.sql(registry.ORACLE_SQL[name]).df()) and got


def value(spark, expr, **boxes):
    columns = ", ".join(f"{v} AS {p}_{k}" for p, b in boxes.items() for k, v in zip("xywh", b))
    return spark.sql(f"SELECT {expr} AS v FROM (SELECT {columns})").first()["v"]


def test_touching_boxes(spark):
    pair = {"a": (0, 0, 10, 10), "b": (10, 0, 10, 10)}
    assert value(spark, G.overlaps("a_", "b_"), **pair) is True
    assert value(spark, G.overlap("a_", "b_"), **pair) == 0
    assert value(spark, G.edge_distance("a_", "b_"), **pair) == 0


def test_equal_boxes_do_not_connect(spark):
    pair = {"a": (5, 5, 10, 10), "b": (5, 5, 10, 10)}
    assert value(spark, G.contains("a_", "b_"), **pair) and value(spark, G.connection("a_", "b_", "20e0"), **pair) == 0
    assert value(spark, G.connection("a_", "b_", "0e0"), a=(0, 0, 5, 5), b=(9, 0, 5, 5)) == 0


def test_even_kernel_is_one_wider():
    plane = np.zeros((21, 21), np.uint8)
    plane[10, 10] = 255
    from pageloom.sources.frames import slide

    assert (slide(plane, 8, 1) > 0).sum() == 9
    assert (close_plane(plane, 3, 3) >= plane).all()


def test_plane_kernel_agrees_with_windows(spark):
    from pageloom import fixtures as X
    from pageloom.operators import pixels as P

    held = P.dense(X.pixels(spark, SF), 64, 64)
    one = held.where("image_id = 0").toPandas().sort_values(["y", "x"])
    closed = P.close(held, 5, 3).where("image_id = 0").toPandas().sort_values(["y", "x"])
    assert (close_plane(one["v"].to_numpy().reshape(64, 64).astype(np.int32), 5, 3).ravel() == closed["v"].to_numpy()).all()


def test_png_is_readable(spark, tmp_path):
    from pageloom.sources.frames import frame_pixels, read_frames

    plane = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    (tmp_path / "a.png").write_bytes(png(plane))
    got = frame_pixels(read_frames(spark, str(tmp_path))).toPandas().sort_values(["y", "x"])
    assert (got[["r", "g", "b"]].to_numpy() == plane.reshape(-1, 3)).all()


EVENT = {"kind": "move", "box": "0,0,9,9", "cluster": "0,0,9,9;20,0,9,9", "gap2": 0, "inside": "0,0,9,9", "inside_cluster": "0,0,9,9;20,0,9,9", "px": 1, "py": 1}


def after(*events, start=START):
    state = start
    for e in events:
        state, _ = step(state, EVENT | e)
    return dict(zip(("hovered", "members", "selected", "flow", "auto", "rect", "anchor", "dragging"), state))


def test_session_hover_and_modes():
    move, far = {}, {"box": "40,0,9,9", "cluster": "40,0,9,9", "gap2": 400}
    auto, flow = {"kind": "toggle_autocluster"}, {"kind": "toggle_flow"}
    assert after(move)["selected"] == "0,0,9,9"
    assert step(step(START, EVENT)[0], EVENT)[1] is False
    assert after(move, auto)["selected"] == "0,0,9,9;20,0,9,9"
    assert after(move, auto, auto)["selected"] == "0,0,9,9"
    # a mode's key without a hovered box empties the selection; flow doesn't end autocluster
    assert after(auto)["selected"] == "" and after(move, auto, flow)["selected"] == "0,0,9,9;20,0,9,9"
    assert after(move, flow, far)["hovered"] == "0,0,9,9" and after(move, flow, far | {"gap2": 224})["selected"] == "0,0,9,9;40,0,9,9"
    assert after(move, {"kind": "dismiss"}) == after()


def test_session_click():
    assert after({}, {"kind": "click"})["selected"] == ""
    inner = {"box": "1,1,3,3", "cluster": "1,1,3,3"}
    assert after({}, {"kind": "click"}, {"kind": "click"}, inner, {"kind": "click"})["selected"] == ""
    # of boxes that hold each other the outer one stays
    assert after({}, {"kind": "toggle_flow"}, inner, {"kind": "click"}, {"kind": "click"})["selected"] == "0,0,9,9"
    # press and release on one spot are a click, which also ends a drawn rectangle without a hovered box
    drawn = [{"kind": "press"}, {"px": 30, "py": 9}, {"kind": "release"}]
    assert after({}, *drawn)["rect"] == "1,1,29,8" and after({}, *drawn)["hovered"] == after({}, *drawn)["selected"] == ""
    assert after({}, *drawn, {"kind": "press"}, {"kind": "release"}) == after()


def test_session_drag():
    press, release = {"kind": "press"}, {"kind": "release"}
    assert after({}, press, {"px": 7, "py": 7}, release)["selected"] == ""  # not over the threshold: a click
    assert after({}, press, {"px": 8})["dragging"] and after(press, {"px": 8}, {"px": 2})["rect"] == "1,1,1,0"
    drawn = [press, {"px": 30}, release]
    # a kept rectangle doesn't make the next small move a drag
    assert after(*drawn, press, {"px": 3})["rect"] == "1,1,29,0"
    assert after(*drawn, {"inside": None})["rect"] == "1,1,29,0"
    held = {"box": "5,5,1,1", "cluster": "5,5,1,1", "inside": "0,0,9,9"}
    assert after(*drawn, held)["selected"] == "0,0,9,9" and after(*drawn, held)["rect"] == ""
    # autocluster expands the box that holds the pointer, not the nearest one
    assert after({"kind": "toggle_autocluster"}, *drawn, held)["selected"] == "0,0,9,9;20,0,9,9"
    assert after({"kind": "toggle_autocluster"}, {"kind": "toggle_flow"}, *drawn, held)["selected"] == "0,0,9,9"


def test_session_replay_has_clusters_and_rectangles(spark):
    got = registry.QUERIES["e1_e6_session_replay"](spark, SF).toPandas()
    assert got["rect"].ne("").any() and got["selected"].str.contains(";").any()
    assert set(got["kind"]) >= {"move", "click", "toggle_autocluster", "toggle_flow", "dismiss"}


def test_session_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from pageloom.streaming.sessions import COLUMNS, replay, stream, use_rocksdb

    kinds = ["move", "press", "move", "release", "move", "click", "toggle_flow", "move"]
    data = [(s, 100 * s + k, k, kind, 20 * k, 3, f"{10 * k},0,9,9", 0, f"{10 * k},0,9,9", None, None) for s in (1, 2) for k, kind in enumerate(kinds)]
    events = spark.createDataFrame(data, "session_id long, event_id long, t int, kind string, px int, py int, box string, gap2 long, inside string, cluster string, inside_cluster string")
    events = events.withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)).select(*COLUMNS)
    later = events.limit(1).withColumn("session_id", F.lit(9).cast("long")).withColumn("ts", F.expr("ts + interval 20 hours"))
    events.union(later).coalesce(1).write.parquet(str(tmp_path / "in"))
    use_rocksdb(spark)
    asked = stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    asked.awaitTermination(120)
    assert rows(spark.table("changes").toPandas()) == rows(replay(events).toPandas()) != []


def test_paragraph_cuts_read_the_words_own_edges(spark):
    from pageloom.operators import network as N

    words = [(1, 30 * k, 0, 20, 10, 0, True, 0) for k in range(12)]
    big = (1, 0, 15, 300, 100, 0, False, None)
    boxes = spark.createDataFrame([*words, big], "image_id long, x int, y int, w int, h int, sea int, is_word boolean, line_id int")
    edge = lambda a, b: (1, a[1:5], b[1:5])
    schema = "image_id long, src struct<x:int,y:int,w:int,h:int>, dst struct<x:int,y:int,w:int,h:int>"
    one_way = spark.createDataFrame([edge(big, words[0]), edge(words[1], big), edge(big, words[1])], schema)
    cut = N.paragraph_cuts(one_way, boxes)
    assert [(r["src"]["x"], r["dst"]["w"]) for r in cut.collect()] == [(30, 300)]
    left = N.without(one_way, cut).collect()
    assert [(r["src"]["w"], r["dst"]["x"]) for r in left] == [(300, 0)]


def test_frames_to_boxes(spark, tmp_path):
    """PNG files with 64-bit ids of their paths, through pixels, edges, closing and components, against a flood fill."""
    from pyspark.sql import functions as F

    from pageloom.operators import detect as D, pixels as P
    from pageloom.sources.frames import frame_pixels, read_frames

    rng = np.random.default_rng(4)
    for k in range(3):
        plane = np.full((24, 24, 3), 255, np.uint8)
        for _ in range(4):
            y, x = rng.integers(0, 20, 2)
            plane[y : y + rng.integers(2, 8), x : x + rng.integers(2, 8)] = rng.integers(0, 120, 3)
        (tmp_path / f"{k}.png").write_bytes(png(plane))
    pixels = frame_pixels(read_frames(spark, str(tmp_path)))
    plane = D.lab_plane(pixels)
    edges = P.canny(P.dense(plane.withColumnRenamed("l", "v"), 24, 24), 3, 40).withColumn("v", F.lit(255))
    mask = P.close(P.dense(edges, 24, 24), 3, 2).where("v > 0")
    want = set()
    for image, part in mask.toPandas().groupby("image_id"):
        left = {*zip(part.y, part.x)}
        while left:
            todo, seen = [left.pop()], []
            while todo:
                y, x = todo.pop()
                seen.append((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                todo += near
            (y0, x0), (y1, x1) = map(min, zip(*seen)), map(max, zip(*seen))
            if x1 - x0 + 1 >= 3 and y1 - y0 + 1 >= 2 and (x1 - x0 + 1) * (y1 - y0 + 1) <= 0.6 * 576:
                want.add((image, x0, y0, x1 - x0 + 1, y1 - y0 + 1))
    for source, side in ((plane, 24), (plane, 10), (pixels, 7)):
        got = D.detect_boxes(source, 24, 24, (3, 2), side).collect()
        assert {(r["image_id"], r["x"], r["y"], r["w"], r["h"]) for r in got} == want and want


def test_detect_network(spark):
    boxes = registry.QUERIES["d2_detect_layout"](spark, SF).toPandas()
    edges = registry.QUERIES["d3_detect_network"](spark, SF).toPandas()
    assert boxes.is_word.any() and len(edges) and edges["origin"].notna().all()
    key = lambda df, p: set(zip(df.image_id, *(df[p + k] for k in "xywh")))
    assert key(edges, "a_") | key(edges, "b_") <= key(boxes, "")
    assert boxes[boxes.is_word].line_id.notna().all()


def test_colour_folds(spark):
    """Dominant colours and colour groups against plain loops."""
    boxes = registry._tiles(spark, SF).toPandas()
    plane = {(r.image_id, r.y, r.x): (r.v // 24 * 24, r.g // 64 * 64, 128) for r in registry.X.pixels(spark, SF).toPandas().itertuples()}
    d2 = lambda p, q: sum((int(a) - int(b)) ** 2 for a, b in zip(p, q))
    pairs = {}
    for b in boxes.itertuples():
        stride, groups = max(1, int((b.w * b.h / 400) ** 0.5)), []
        for y in range(b.y, b.y + b.h, stride):
            for x in range(b.x, b.x + b.w, stride):
                if (c := plane.get((b.image_id, y, x))) is not None:
                    near = next((g for g in groups if d2([s // g[1] for s in g[0]], c) < 36), None)
                    if near:
                        near[0], near[1] = [s + v for s, v in zip(near[0], c)], near[1] + 1
                    else:
                        groups.append([list(c), 1])
        means = [tuple(int(s) // n for s in total) for total, n in sorted(groups, key=lambda g: -g[1])]
        pairs[b.image_id, b.y, b.x, b.h, b.w] = (means[0], next((m for m in means if d2(m, means[0]) > 900), means[0]))
    got = registry.QUERIES["a4_a5_dominant_colours"](spark, SF).toPandas()
    assert {(r.image_id, r.y, r.x, r.h, r.w): ((r.primary_l, r.primary_a, r.primary_b), (r.secondary_l, r.secondary_a, r.secondary_b)) for r in got.itertuples()} == pairs

    def agree(p, q):
        one, other = d2(*p) < 9, d2(*q) < 9
        if one and other:
            return d2(p[0], q[0]) < 9
        if one or other:
            single, double = (p, q) if one else (q, p)
            return any(d2(single[0], c) < 9 for c in double)
        return all(d2(a, b) < 9 for a, b in zip(p, q)) or all(d2(a, b) < 9 for a, b in zip(p, q[::-1]))

    founders, want = {}, {}
    for key in sorted(pairs):
        seen = founders.setdefault(key[0], [])
        hit = next((k for k, f in enumerate(seen) if agree(f, pairs[key])), None)
        if hit is None:
            seen.append(pairs[key])
            hit = len(seen) - 1
        want[key] = hit
    seas = registry.QUERIES["a6_seas"](spark, SF).toPandas()
    assert {(r.image_id, r.y, r.x, r.h, r.w): r.sea_id for r in seas.itertuples()} == want


def test_written_crops(spark, tmp_path):
    from pageloom.sources.frames import write_files

    files = spark.createDataFrame([("a.png", png(np.zeros((2, 3, 3), np.uint8)))], "name string, png binary")
    for _ in range(2):
        write_files(files, f"file://{tmp_path}/deep/folder")
    assert (tmp_path / "deep/folder/a.png").read_bytes()[:4] == b"\x89PNG"


def test_network_invariants(spark):
    edges = registry.QUERIES["n4_network"](spark, SF).toPandas()
    assert len(edges) and edges["origin"].notna().all()
    assert not ((edges.a_x == edges.b_x) & (edges.a_y == edges.b_y) & (edges.a_w == edges.b_w) & (edges.a_h == edges.b_h)).any()


def test_components(spark):
    from pageloom.plans.components import connected_components

    edges = [(1, 2), (2, 3), (9, 8), (3, 1), (7, 7), (8, 9), (20, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 8: 8, 9: 8}
