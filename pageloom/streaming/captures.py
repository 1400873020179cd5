"""A stream of frames to detected boxes and PNG files.

Frames come as image files in folders. Each micro-batch is detected as a batch of frames would
be, its tables go to a partition of their own, and its files to a folder of their own, both named
by the batch id. A batch that is run again after a failure holds the same frames (the checkpoint
says which) and replaces what it wrote before, so each frame's results stand once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.operators import detect as D, tiles as T
from pageloom.runtime import Scratch
from pageloom.sources.frames import cut_files, write_files
from pageloom.sources.words import Provider, recognise

_NO_WORDS = "image_id long, word_idx int, line_id int, text string, confidence float, x int, y int, w int, h int"


def box_rects(boxes: DataFrame) -> DataFrame:
    """A named rectangle for each box, in pixels: what is cut if nothing else is asked for."""
    name = F.format_string("Capture_%d_%d_%d_%d_%d.png", "image_id", "x", "y", "w", "h")
    return boxes.select("image_id", name.alias("name"), F.col("x").alias("left"), F.col("y").alias("top"), F.expr("x + w").alias("right"), F.expr("y + h").alias("bottom"))


@dataclass
class CaptureSink:
    """For foreachBatch, and for a table of frames with any number as its batch id.

    Writes ``{folder}/boxes/batch_id=N`` and ``{folder}/files/batch_id=N``; with ``network`` also words and edges
    of the whole layout, whose boxes then are those of the network. ``rects`` turns boxes into the rectangles to cut.
    Screens come in few sizes; each size of a batch is detected on its own.
    """

    folder: str
    provider: Provider | None = None
    network: bool = False
    tuned_as: float | None = None
    rects: object = box_rects

    def __call__(self, frames: DataFrame, batch_id: int) -> None:
        spark = frames.sparkSession
        scratch = Scratch(spark, "capture")
        frames = scratch.save(frames, "frames")
        tables: dict[str, DataFrame] = {}
        words = scratch.save(recognise(frames, self.provider), "words") if self.provider else spark.createDataFrame([], _NO_WORDS)
        for size in frames.select("width", "height").distinct().orderBy("width", "height").collect():
            width, height = size
            some = frames.where((F.col("width") == width) & (F.col("height") == height))
            for name, table in self._detect(some, words.join(some.select("image_id"), "image_id", "left_semi"), width, height).items():
                tables[name] = tables[name].unionByName(table) if name in tables else table
        for name, table in tables.items():
            tables[name] = self._put(spark, table, name, batch_id)
        if tables:
            files = scratch.save(cut_files(frames, self.rects(tables["boxes"])), "files")
            target = f"{self.folder}/files/batch_id={batch_id}"
            _remove(spark, target)
            write_files(files, target)
        scratch.drop("frames", "words", "files")

    def _detect(self, frames: DataFrame, words: DataFrame, width: int, height: int) -> dict[str, DataFrame]:
        if self.network:
            found = D.detect_frames(frames, words, width, height, self.tuned_as)
            return {"boxes": found.boxes, "edges": found.edges, "words": words}
        edges = T.Edges(T.Grid(width, height), D.LOW, D.HIGH, D.kernel_of(self.tuned_as or height))
        return {"boxes": D.edge_boxes(edges, T.tiles_of_frames(frames, edges.grid))}

    def _put(self, spark, table: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = f"{self.folder}/{name}/batch_id={batch_id}"
        table.write.mode("overwrite").parquet(path)
        return spark.read.schema(table.schema).parquet(path)


def _remove(spark, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def capture_stream(frames: DataFrame, sink: CaptureSink, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts ``sink`` on a stream of frames (``sources.frames.stream_frames``); ``checkpoint`` is a shared folder."""
    return frames.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
