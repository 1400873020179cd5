"""Sessions over streams in order of event time, whatever batches bring; keys as of the settings in force; saves."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom import registry
from pageloom.streaming.sessions import COLUMNS, START, View, play, replay, saved_rect, stream, use_rocksdb
from tests.test_layout import rows

SF = "/root/testdata/sf0.001"
SCHEMA = "session_id long, event_id long, ms long, kind string, px int, py int, box string, gap2 double, inside string, cluster string, inside_cluster string"
KINDS = ["move", "move", "press", "move", "release", "move", "click", "toggle_flow", "save", "copy", "toggle_autocluster", "dismiss", "preview", "other"]


def made(spark, seed, n=140, sessions=3):
    rnd = random.Random(seed)
    box = lambda: f"{rnd.randint(0, 5) * 10},{rnd.randint(0, 3) * 10},9,9"
    data = []
    for k in range(n):
        near, inside = box(), rnd.choice([None, box()])
        data.append((rnd.randrange(sessions), k, 1000 * (k // 3) + k % 3 * rnd.choice([0, 400]), rnd.choice(KINDS), rnd.randint(0, 90), rnd.randint(0, 90), near, float(rnd.choice([0, 100, 400])), inside, f"{near};0,0,99,99", f"{inside};1,1,2,2" if inside else None))
    events = spark.createDataFrame(data, SCHEMA).withColumn("ts", F.expr("timestamp_millis(1700000000000 + ms)")).select(*COLUMNS)
    return events, data


def run(spark, events, tmp_path, name):
    """Feeds what is new in ``events`` and returns all rows so far."""
    asked = stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "30 seconds", 60_000).writeStream
    asked = asked.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    asked.awaitTermination(300)
    return spark.read.parquet(str(tmp_path / "out"))


def test_late_events_in_any_batches_give_the_replay(spark, tmp_path):
    use_rocksdb(spark)
    events, data = made(spark, 5)
    # dealt to files by a shuffle over 20 seconds, so that batches interleave; the stream is stopped and restarted between files
    order = sorted(range(len(data)), key=lambda k: data[k][2] + random.Random(k).randint(0, 20_000))
    parts = [order[a : a + 35] for a in range(0, len(order), 35)]
    for n, part in enumerate(parts):
        events.where(F.col("event_id").isin(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n in (1, len(parts) - 1):
            if n == len(parts) - 1:
                # another session's event moves the watermark beyond all, and the next batch plays what waits
                for later in (10, 20):
                    events.limit(1).select(F.lit(99).cast("long").alias("session_id"), F.lit(-later).cast("long").alias("event_id"), (F.col("ts") + F.expr(f"interval {later} hours")).alias("ts"), *COLUMNS[3:]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            got = run(spark, events, tmp_path, "changes")
    want = replay(events)
    assert rows(got.where("session_id <> 99").toPandas()) == rows(want.toPandas()) != []
    assert {r["kind"] for r in want.collect()} >= {"save", "copy", "preview", "move", "dismiss"}


def test_saved_rect():
    view = View(8, 100, 60)
    state = lambda **k: tuple(dict(zip(("hovered", "members", "selected", "flow", "auto", "rect", "anchor", "dragging"), START)).copy().__or__(k).values())
    assert saved_rect(state(), view) == ""
    assert saved_rect(state(selected="10,10,5,5;20,2,9,9"), view) == "2,0,35,23"
    assert saved_rect(state(selected="90,50,30,30"), view) == "82,42,18,18"
    # a drawn rectangle has no padding and comes before the selection
    assert saved_rect(state(selected="1,1,1,1", rect="30,20,7,0"), view) == "30,20,7,0"
    event = {"session_id": 1, "event_id": 2}
    chosen = state(hovered="1,1,4,4", selected="1,1,4,4")
    assert play(chosen, event | {"kind": "save"}, view) == (chosen, event | {"kind": "save", "hovered": "1,1,4,4", "selected": "1,1,4,4", "rect": "0,0,13,13"})
    assert play(chosen, event | {"kind": "preview"}, view)[0] == START and play(START, event | {"kind": "preview"}, view) == (START, None)


KEYS = "user_id long, event_id long, at int, key_code int, flags long"
SETTINGS = "user_id long, at int, action string, key_code int, mods long"


def brute_dispatch(keys, settings):
    from pageloom.streaming.keys import DEFAULTS, MASK, ORDER

    out = {}
    for user, event, at, code, flags in keys:
        kind = "dismiss" if code == 53 else None
        for action in ORDER:
            known = sorted((t, c, m) for u, t, a, c, m in settings if u == user and a == action and t <= at)
            held = known[-1][1:] if known else DEFAULTS[action]
            if kind is None and held == (code, flags & MASK):
                kind = action
        out[event] = kind
    return out


@pytest.mark.parametrize("sent", [1 << 18, 0])
def test_dispatch(spark, monkeypatch, sent):
    from pageloom.streaming import keys as K

    monkeypatch.setattr(K, "SENT", sent)
    rnd = random.Random(sent % 97)
    shift, other = 1 << 17, 1 << 8
    keys = [(rnd.choice([1, 1, 1, 2, 3]), k, rnd.randint(0, 30), rnd.choice([0, 1, 3, 8, 9, 12, 53, 99]), rnd.choice([0, 0, shift, other, shift | other])) for k in range(300)]
    settings = [(rnd.choice([1, 2]), rnd.randint(0, 30), rnd.choice(K.ORDER), rnd.choice([0, 1, 3, 8, 9, 12, 99]), rnd.choice([0, shift])) for _ in range(40)]
    stamp = lambda df: df.withColumn("ts", F.expr("timestamp_seconds(at)")).drop("at")
    got = K.dispatch(stamp(spark.createDataFrame(keys, KEYS)), stamp(spark.createDataFrame(settings, SETTINGS))).collect()
    want = brute_dispatch(keys, settings)
    assert {r["event_id"]: r["kind"] for r in got} == want and len(got) == len(keys) and set(want.values()) >= {None, *K.ORDER}


def test_saves_reach_the_frames_pixels(spark, tmp_path):
    """A session's saved rectangle, cut out of its frame at twice the view's size."""
    import numpy as np

    from pageloom.sources.frames import cut_files, png, read_frames
    from pageloom.streaming.keys import save_files

    plane = np.random.default_rng(1).integers(0, 256, (40, 60, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(plane))
    frames = read_frames(spark, str(tmp_path))
    image = frames.first()["image_id"]
    changes = spark.createDataFrame([(1, 5, "save", "", "", "2,3,10,8"), (1, 6, "move", "", "", ""), (1, 7, "copy", "", "", "0,0,30,20")], "session_id long, event_id long, kind string, hovered string, selected string, rect string")
    events = spark.sql(f"SELECT id AS event_id, {image} AS image_id, timestamp'2024-05-06 07:08:09' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts FROM range(5, 8)")
    got = save_files(changes, events).collect()
    assert [(r["event_id"], r["name"], r["left"], r["top"], r["right"], r["bottom"]) for r in got] == [(5, "Capture_20240506_070814.png", 2, 3, 12, 11)]
    cut = cut_files(frames, save_files(changes, events), 30, 20).collect()
    assert [(r["name"], bytes(r["png"])) for r in cut] == [("Capture_20240506_070814.png", png(plane[6:22, 4:24]))]
