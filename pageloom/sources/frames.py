"""Image files in and out: frames to pixel rows or planes, and crops to PNG files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.runtime import ship


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Image files as rows: image_id (hash of the path), path, height, width, channels, data (rows of BGR or BGRA bytes)."""
    return _frames(spark.read.format("image").load(path))


def stream_frames(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same over a stream of image files; ``path`` may name many folders by a pattern."""
    schema = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    return _frames(spark.readStream.format("image").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path))


def _frames(images: DataFrame) -> DataFrame:
    images = images.select("image.*").where("nChannels in (1, 3, 4)")
    return images.select(F.xxhash64("origin").alias("image_id"), F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data")


def frame_planes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(image_id, pixels as rows, columns, r g b) of batches of frames."""
    for batch in batches:
        for image, height, width, channels, data in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("image_id", "height", "width", "channels", "data"))):
            plane = np.frombuffer(data.as_buffer(), np.uint8).reshape(height.as_py(), width.as_py(), channels.as_py())
            yield image.as_py(), plane[..., [2, 1, 0] if channels.as_py() >= 3 else [0, 0, 0]]


def frame_pixels(frames: DataFrame) -> DataFrame:
    """image_id, y, x, r, g, b of every pixel; the bytes are unpacked in whole arrays."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                plane = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.channels)
                b, g, r = (plane[..., k if row.channels >= 3 else 0].ravel() for k in range(3))
                y, x = np.divmod(np.arange(row.height * row.width), row.width)
                yield pd.DataFrame({"image_id": row.image_id, "y": y.astype("int32"), "x": x.astype("int32"), "r": r.astype("int32"), "g": g.astype("int32"), "b": b.astype("int32")})

    return frames.mapInPandas(unpack, "image_id long, y int, x int, r int, g int, b int")


def slide(plane: np.ndarray, k: int, axis: int, agg=np.maximum, fill: int = 0) -> np.ndarray:
    """A clipped window of 2 * (k // 2) + 1 along an axis of a 2-d plane."""
    half = k // 2
    out = plane.copy()
    for d in range(1, half + 1):
        ahead, behind = np.full_like(plane, fill), np.full_like(plane, fill)
        cut = lambda a, b: tuple(slice(a, b) if n == axis else slice(None) for n in (0, 1))
        if d < plane.shape[axis]:
            ahead[cut(None, -d)], behind[cut(d, None)] = plane[cut(d, None)], plane[cut(None, -d)]
        out = agg(out, agg(ahead, behind))
    return out


def close_plane(plane: np.ndarray, kx: int, ky: int) -> np.ndarray:
    """Closing of one whole plane, for frames that are too large for a row a pixel."""
    grown = slide(slide(plane, kx, 1), ky, 0)
    return slide(slide(grown, kx, 1, np.minimum, 255), ky, 0, np.minimum, 255)


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB PNG file of a plane (height, width, 3)."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width = rgb.shape[:2]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def crop_files(pixels: DataFrame, stamp: str = "1970-01-01 00:00:00") -> DataFrame:
    """One PNG an image of ``pixels`` (image_id, y, x, r, g, b), cut to their extent: image_id, name, png."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"] - pdf["y"].min(), pdf["x"] - pdf["x"].min()
        plane = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3), np.uint8)
        plane[y, x] = pdf[["r", "g", "b"]].to_numpy(np.uint8)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "png": [png(plane)]})

    files = pixels.groupBy("image_id").applyInPandas(encode, "image_id long, png binary")
    return files.select("image_id", F.concat(F.lit("Capture_"), F.date_format(F.lit(stamp).cast("timestamp"), "yyyyMMdd_HHmmss"), F.lit("_"), F.col("image_id").cast("string"), F.lit(".png")).alias("name"), "png")


def cut_files(frames: DataFrame, rects: DataFrame, view_width: float | None = None, view_height: float | None = None) -> DataFrame:
    """One PNG a row of ``rects`` (image_id, name, left, top, right, bottom), cut out of its frame: image_id, name, png.

    Rectangles are in the view's units if its size is given, else in pixels; they are rounded outwards and held inside
    the frame, and those of which nothing is left are dropped. A frame's rectangles travel together, so its pixels move once at most.
    """
    ship(frames.sparkSession)
    sides = ("left", "top", "right", "bottom")
    listed = rects.groupBy("image_id").agg(F.collect_list(F.struct("name", *(F.col(c).cast("double").alias(c) for c in sides))).alias("rects"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (image, plane), wanted in zip(frame_planes([batch]), batch.column(batch.schema.get_field_index("rects"))):
                height, width = plane.shape[:2]
                sx, sy = width / (view_width or width), height / (view_height or height)
                for r in wanted.as_py():
                    x0, y0 = max(0, int(np.floor(r["left"] * sx))), max(0, int(np.floor(r["top"] * sy)))
                    x1, y1 = min(width, int(np.ceil(r["right"] * sx))), min(height, int(np.ceil(r["bottom"] * sy)))
                    if x0 < x1 and y0 < y1:
                        yield pa.RecordBatch.from_arrays([pa.array([image], pa.int64()), pa.array([r["name"]]), pa.array([png(plane[y0:y1, x0:x1])], pa.binary())], ["image_id", "name", "png"])

    return frames.select("image_id", "height", "width", "channels", "data").join(listed, "image_id").mapInArrow(cut, "image_id long, name string, png binary")


def write_files(files: DataFrame, folder: str) -> None:
    """Writes ``files(name, png)`` into a folder that all executors share, made if missing; a file of the same name is replaced.

    A task that is run again writes the same files again.
    """

    def put(rows: Iterator) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for row in rows:
            with system.open_output_stream(f"{base}/{row['name']}") as out:
                out.write(bytes(row["png"]))

    files.select("name", "png").foreachPartition(put)
