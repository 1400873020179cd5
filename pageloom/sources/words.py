"""Recognised words of frames from a pluggable provider.

A provider is a function of a frame's pixels (rows, columns, r g b) that gives lines: a text, a
confidence and the corners of each word of the text. Corners are shares of the frame's width and
height, counted from its lower left corner, so any recogniser can be put in. Corners become boxes of
pixels in ``functions.geometry``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.functions import geometry as G
from pageloom.runtime import ship
from pageloom.sources.frames import frame_planes


@dataclass
class Line:
    """Corners are four (x, y) for each white-space word of ``text``, or None where the recogniser has none: that word is left out."""

    text: str
    confidence: float = 1.0
    corners: list = field(default_factory=list)


Provider = Callable[[np.ndarray], Iterable[Line]]
CORNERS = [f"{c}{k}" for k in range(4) for c in "xy"]
_WORD = "image_id long, width int, height int, word_idx int, line_id int, text string, confidence float, " + ", ".join(f"{c} double" for c in CORNERS)


def recognise(frames: DataFrame, provider: Provider) -> DataFrame:
    """image_id, word_idx, line_id, text, confidence, x, y, w, h of the words that ``provider`` finds in frames (image_id, height, width, channels, data).

    A frame on which the provider fails has no words; so has one without text. Lines are numbered as they come, words over the frame.
    """
    ship(frames.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image, plane in frame_planes(batches):
            try:
                lines = list(provider(plane))
            except Exception:
                lines = []
            rows = []
            for number, line in enumerate(lines):
                for text, corners in zip(line.text.split(), line.corners):
                    if corners is not None:
                        rows.append((image, plane.shape[1], plane.shape[0], len(rows), number, text, line.confidence, *(float(v) for corner in corners for v in corner)))
            if rows:
                types = [pa.int64(), *[pa.int32()] * 4, pa.string(), pa.float32(), *[pa.float64()] * 8]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], [f.split()[0] for f in _WORD.split(", ")])

    found = frames.select("image_id", "height", "width", "channels", "data").mapInArrow(read, _WORD)
    box = G.quad_box([f"x{k}" for k in range(4)], [f"y{k}" for k in range(4)], "width", "height")
    return found.select("image_id", "word_idx", "line_id", "text", "confidence", *(F.expr(e).alias(k) for k, e in box.items()))
