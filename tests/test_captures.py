"""A stream of image files to boxes and PNG files, restarted; words from a provider that reads rendered pages."""

import numpy as np
import pytest

from pageloom.operators import tiles as T
from pageloom.sources.frames import cut_files, png, read_frames, stream_frames
from pageloom.sources.words import Line, recognise
from pageloom.streaming.captures import CaptureSink, capture_stream


def page(seed, width=40, height=28):
    rng = np.random.default_rng(seed)
    plane = np.full((height, width, 3), 255, np.uint8)
    for _ in range(4):
        y, x = rng.integers(1, height - 9), rng.integers(1, width - 9)
        plane[y : y + rng.integers(3, 8), x : x + rng.integers(3, 8)] = rng.integers(0, 120, 3)
    return plane


def files(folder):
    return {p.name: p.read_bytes() for p in folder.rglob("*.png")}


def boxes(spark, folder):
    return sorted(map(tuple, spark.read.parquet(f"{folder}/boxes").select("image_id", "x", "y", "w", "h").collect()))


class Breaks(CaptureSink):
    """Writes tables and files of a batch, leaves a stray file, then fails, as if the driver were lost before the commit."""

    def __call__(self, frames, batch_id):
        super().__call__(frames, batch_id)
        from pathlib import Path

        Path(f"{self.folder}/files/batch_id={batch_id}/left.png").write_bytes(b"half")
        raise RuntimeError("lost")


def test_stream_restarts_and_equals_the_batch(spark, tmp_path):
    out, whole = tmp_path / "out", tmp_path / "whole"
    for folder, seeds in (("in_a", (1, 2)), ("in_b", (3, 4))):
        (tmp_path / folder).mkdir()
        if folder == "in_a":
            for k in seeds:
                (tmp_path / folder / f"{k}.png").write_bytes(png(page(k)))
    run = lambda sink: capture_stream(stream_frames(spark, f"file://{tmp_path}/in_*"), sink, str(tmp_path / "state")).awaitTermination(200)
    run(CaptureSink(str(out), tuned_as=800))
    first = files(out)
    assert first
    # another folder, with a frame of another size; the batch fails after its files and is run again from the checkpoint
    (tmp_path / "in_b" / "3.png").write_bytes(png(page(3)))
    (tmp_path / "in_b" / "4.png").write_bytes(png(page(4, 50, 33)))
    with pytest.raises(Exception, match="lost"):
        run(Breaks(str(out), tuned_as=800))
    assert "left.png" in files(out)
    run(CaptureSink(str(out), tuned_as=800))
    run(CaptureSink(str(out), tuned_as=800))  # nothing new
    CaptureSink(str(whole), tuned_as=800)(read_frames(spark, f"file://{tmp_path}/in_*"), 0)
    assert files(out) == files(whole) and len(files(out)) > len(first)
    assert boxes(spark, out) == boxes(spark, whole) and len(boxes(spark, out)) == len(files(out))


def reader(plane):
    """Reads rendered pages: dark blobs are words, blobs of the same rows are a line; a red page makes it fail."""
    if (plane[0, 0] == (255, 0, 0)).all():
        raise ValueError("unreadable")
    height, width = plane.shape[:2]
    _, found = T.label_runs(plane[..., 0] < 100)
    lines = {}
    for x0, y0, x1, y1 in sorted(map(tuple, found), key=lambda b: (b[1], b[0])):
        corners = [(x / width, 1 - y / height) for x in (x0, x1 + 1) for y in (y0, y1 + 1)]
        lines.setdefault(y0, []).append((f"w{x1 - x0 + 1}", corners))
    return [Line(" ".join(t for t, _ in line), 0.5, [None if t == "w2" else c for t, c in line]) for line in lines.values()]


def rendered():
    plane = np.full((60, 90, 3), 255, np.uint8)
    for y, x, w in ((5, 4, 12), (5, 20, 2), (5, 30, 20), (25, 4, 30), (40, 10, 7)):
        plane[y : y + 6, x : x + w] = 20
    return plane


def test_provider(spark, tmp_path):
    red = np.zeros((9, 9, 3), np.uint8)
    red[..., 0] = 255
    for name, plane in (("page", rendered()), ("red", red), ("empty", np.full((9, 9, 3), 255, np.uint8))):
        (tmp_path / f"{name}.png").write_bytes(png(plane))
    got = recognise(read_frames(spark, str(tmp_path)), reader).orderBy("word_idx").collect()
    assert [(r["word_idx"], r["line_id"], r["text"], r["x"], r["y"], r["w"], r["h"]) for r in got] == [
        (0, 0, "w12", 4, 5, 12, 6), (1, 0, "w20", 30, 5, 20, 6), (2, 1, "w30", 4, 25, 30, 6), (3, 2, "w7", 10, 40, 7, 6),
    ]


def test_network_of_frames_with_provider(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.png").write_bytes(png(rendered()))
    CaptureSink(str(tmp_path / "out"), provider=reader, network=True, tuned_as=800)(read_frames(spark, f"file://{tmp_path}/in"), 7)
    found = spark.read.parquet(f"{tmp_path}/out/boxes").toPandas()
    # every word is a box of the network, tagged by its own word
    words = spark.read.parquet(f"{tmp_path}/out/words").toPandas()
    key = lambda df: set(zip(*(df[c] for c in ("image_id", "x", "y", "w", "h"))))
    assert len(words) == 8 and key(words) == key(found[found.is_word])
    edges = spark.read.parquet(f"{tmp_path}/out/edges")
    assert edges.where("src is null or dst is null or origin is null").count() == 0
    assert len(files(tmp_path / "out")) == len(found)


def test_cut_files(spark, tmp_path):
    plane = np.arange(20 * 30 * 3, dtype=np.uint16).astype(np.uint8).reshape(20, 30, 3)
    (tmp_path / "a.png").write_bytes(png(plane))
    frames = read_frames(spark, str(tmp_path))
    image = frames.first()["image_id"]
    rects = spark.createDataFrame([(image, "a", 1.2, 2.0, 5.1, 9.9), (image, "b", -4.0, 15.0, 99.0, 99.0), (image, "c", 50.0, 1.0, 60.0, 4.0), (5, "d", 0.0, 0.0, 1.0, 1.0)], "image_id long, name string, left double, top double, right double, bottom double")
    whole = {r["name"]: bytes(r["png"]) for r in cut_files(frames, rects).collect()}
    assert whole == {"a": png(plane[2:10, 1:6]), "b": png(plane[15:20, 0:30])}
    half = {r["name"]: bytes(r["png"]) for r in cut_files(frames, rects, 15, 10).collect()}
    assert half == {"a": png(plane[4:20, 2:11])}
