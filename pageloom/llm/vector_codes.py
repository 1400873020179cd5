"""Operator 12. Vector code compression: product codes learned by filtering Lloyd rounds.

Vectors become integers floor(256 x) and are cut into equal parts. Each position of a part
has a codebook of ``entries`` integer vectors, improved by Lloyd rounds and used to code
every vector by one byte a part.

Every task builds, for each block of vectors and each part, a kd-tree whose nodes hold the
bounding box, the sum and the count of their part vectors. The trees are written once. A
round then filters the codebook down the trees, all nodes of a level at once: the entry
nearest to a box's middle beats another one everywhere in the box if it does so in the
corner furthest towards that other one. A node with one entry left gives its cached sum and
count to it, whole; only leaves with several compare vectors. All of it is in integers, so
the result doesn't depend on the blocks. A round sends the driver parts x entries sums;
vectors never leave their block.

Defined cases: vectors that are null, or hold null, NaN or infinite components, are dropped;
so are vectors of another length than the most frequent one (ties: the longer). Lengths that
parts doesn't divide are filled up with zeros. Components beyond 2^23 after scaling are held at
that bound, so that sums stay exact. Fewer vectors than entries give that many entries; an
empty table gives an empty result. Equal ids count as rows of their own (the first entries then
go by components); a null id comes last in the order; null labels count together; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.textkit import releasing
from pageloom.runtime import Scratch, ship

SCALE = 256
BOUND = 1 << 23
LEAF = 16
BLOCK = 8192
#: Up to so many labels, their sums are sent to all executors; beyond, frequent ones are and the rest is joined by a shuffle.
SENT_LABELS = 1 << 16


def tree_levels(n: int, leaf: int = LEAF) -> int:
    """Levels of a balanced tree over n points, so that leaves have at most ``leaf`` of them."""
    levels = 1
    while -(-n >> (levels - 1)) > leaf:
        levels += 1
    return levels


def tree_bounds(n: int, level: int) -> np.ndarray:
    """First point of each node of a level, and n; children halve their parent."""
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


def build_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """An order of points(n, d) in which every node of the tree is a slice: each level sorts a node along its widest axis."""
    n = len(points)
    order = np.arange(n)
    for level in range(tree_levels(n, leaf) - 1):
        bounds = tree_bounds(n, level)
        here = points[order]
        wide = (np.maximum.reduceat(here, bounds[:-1], axis=0) - np.minimum.reduceat(here, bounds[:-1], axis=0)).argmax(axis=1)
        node = np.repeat(np.arange(1 << level), np.diff(bounds))
        order = order[np.lexsort((here[np.arange(n), wide[node]], node))]
    return order


def filter_tree(points: np.ndarray, lows: list[np.ndarray], highs: list[np.ndarray], book: np.ndarray):
    """For a tree (points in its order) and a codebook(k, d): slices [from, to) with their entry.

    ``lows`` and ``highs`` hold the boxes of every level. Exact with ties to the lower index.
    """
    n, k = len(points), len(book)
    square = (book * book).sum(axis=1)
    nodes, left = np.zeros(1, np.int64), np.ones((1, k), dtype=bool)
    found = []
    for level in range(len(lows)):
        bounds = tree_bounds(n, level)
        low, high = lows[level][nodes], highs[level][nodes]
        # twice the middle keeps integers
        to_middle = np.where(left, 4 * square - 4 * (low + high) @ book.T, np.iinfo(np.int64).max)
        best = to_middle.argmin(axis=1)
        # the best entry's square distance minus the other one's, at its largest in the box
        towards = 2 * (book[None, :, :] - book[best][:, None, :])
        most = np.where(towards > 0, towards * high[:, None, :], towards * low[:, None, :]).sum(axis=2) + (square[best][:, None] - square[None, :])
        left &= ~((most < 0) | ((most == 0) & (np.arange(k)[None, :] > best[:, None])))
        left[np.arange(len(nodes)), best] = True
        one = left.sum(axis=1) == 1
        if one.any():
            found.append((bounds[nodes[one]], bounds[nodes[one] + 1], left[one].argmax(axis=1)))
        nodes, left = nodes[~one], left[~one]
        if level + 1 < len(lows):
            nodes = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
            left = np.repeat(left, 2, axis=0)
        elif len(nodes):
            size = bounds[nodes + 1] - bounds[nodes]
            at = np.repeat(bounds[nodes], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            far = np.where(np.repeat(left, size, axis=0), square[None, :] - 2 * points[at] @ book.T, np.iinfo(np.int64).max)
            found.append((at, at + 1, far.argmin(axis=1)))
    return tuple(np.concatenate(x) for x in zip(*found))


class Block:
    """The trees of one block: points of every part in tree order, boxes and running sums."""

    def __init__(self, ordered: np.ndarray, boxes: np.ndarray):
        self.parts, self.n, self.d = ordered.shape
        self.ordered = ordered.astype(np.int64)
        self.sums = np.zeros((self.parts, self.n + 1, self.d), np.int64)
        np.cumsum(self.ordered, axis=1, out=self.sums[:, 1:])
        self.boxes = boxes.astype(np.int64)

    @staticmethod
    def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, points in that order, boxes of all levels one after another) of points(n, parts, d)."""
        n, parts, d = points.shape
        levels = tree_levels(n)
        order = np.empty((parts, n), np.int64)
        boxes = np.empty((parts, (1 << levels) - 1, 2, d), np.int64)
        for p in range(parts):
            order[p] = build_order(points[:, p])
            here = points[order[p], p]
            for level in range(levels):
                first = tree_bounds(n, level)[:-1]
                at = slice((1 << level) - 1, (1 << (level + 1)) - 1)
                boxes[p, at, 0], boxes[p, at, 1] = np.minimum.reduceat(here, first, axis=0), np.maximum.reduceat(here, first, axis=0)
        return order, np.stack([points[order[p], p] for p in range(parts)]), boxes

    def assign(self, p: int, book: np.ndarray):
        levels = tree_levels(self.n)
        cut = [slice((1 << k) - 1, (1 << (k + 1)) - 1) for k in range(levels)]
        return filter_tree(self.ordered[p], [self.boxes[p, c, 0] for c in cut], [self.boxes[p, c, 1] for c in cut], book)


def _integers(batch: pa.RecordBatch, length: int, parts: int) -> np.ndarray:
    """The vectors of a batch as integers (n, parts, d); all have ``length`` finite components."""
    flat = batch.column(batch.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    whole = np.clip(np.floor(flat * SCALE), -BOUND, BOUND).astype(np.int64)
    d = -(-length // parts)
    return np.pad(whole, ((0, 0), (0, parts * d - length))).reshape(len(whole), parts, d)


def _collected(batches, rows: int):
    """Arrow batches gathered to tables of ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, list[np.ndarray]]:
    """(a row for each kept vector: vec_id, label, code, error; the codebooks by part)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte a part: entries must be from 1 to 256")
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "codes")
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = source.where(F.expr("vector is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))"))
    common = finite.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    schema = f"vec_id long, label {dict(source.dtypes)['label']}, code binary, error long"
    if common is None:
        return spark.createDataFrame([], schema), []
    length = common["n"]
    kept = finite.where(F.size("vector") == length)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").toArrow()
    start = _integers(first.combine_chunks().to_batches()[0], length, parts)
    books = [start[:, p].copy() for p in range(parts)]

    @releasing
    def build(batches):
        for batch in _collected(batches, BLOCK):
            order, ordered, boxes = Block.build(_integers(batch, length, parts))
            block = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["vec_id", "label"])
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), block), *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((order, np.uint16), (ordered, np.int32), (boxes, np.int32)))],
                ["rows", "place", "points", "boxes"],
            )

    label_type = dict(source.dtypes)["label"]
    trees = scratch.save(kept.mapInArrow(build, f"rows array<struct<vec_id:long,label:{label_type}>>, place binary, points binary, boxes binary"), "trees")

    def blocks(batches, *more):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("points", "boxes", *more)]
            for k in range(batch.num_rows):
                points = np.frombuffer(columns[0][k].as_buffer(), np.int32).reshape(parts, -1, -(-length // parts))
                boxes = np.frombuffer(columns[1][k].as_buffer(), np.int32).reshape(parts, -1, 2, points.shape[2])
                yield Block(points, boxes), *(c[k] for c in columns[2:])

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        @releasing
        def gather(batches):
            counts = [np.zeros(len(b), np.int64) for b in sent.value]
            sums = [np.zeros_like(b) for b in sent.value]
            for (block,) in blocks(batches):
                for p, book in enumerate(sent.value):
                    low, high, entry = block.assign(p, book)
                    np.add.at(counts[p], entry, high - low)
                    np.add.at(sums[p], entry, block.sums[p, high] - block.sums[p, low])
            for p in range(parts):
                used = np.flatnonzero(counts[p])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[p][used]), pa.array(list(sums[p][used]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        d = books[0].shape[1]
        added = trees.select("points", "boxes").mapInArrow(gather, "part int, entry int, n long, sums array<long>")
        added = added.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(d)))
        # at most parts x entries rows
        books = [b.copy() for b in books]
        for row in added.collect():
            books[row["part"]][row["entry"]] = [row[f"s{j}"] // row["n"] for j in range(d)]

    last = spark.sparkContext.broadcast(books)

    @releasing
    def code(batches):
        for block, rows, place in blocks(batches, "rows", "place"):
            codes, error = np.empty((block.n, parts), np.uint8), np.zeros(block.n, np.int64)
            for p, book in enumerate(last.value):
                low, high, entry = block.assign(p, book)
                at = np.argsort(low)
                entry = np.repeat(entry[at], (high - low)[at])
                back = np.frombuffer(place.as_buffer(), np.uint16).reshape(parts, -1)[p]
                codes[back, p] = entry
                error[back] += ((block.ordered[p] - book[entry]) ** 2).sum(axis=1)
            ids = rows.values
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), block.n, [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([ids.field("vec_id"), ids.field("label"), packed, pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = scratch.save(trees.mapInArrow(code, schema), "coded")
    scratch.drop("trees")
    return coded, books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def with_label_sums(coded: DataFrame, sent_labels: int = SENT_LABELS) -> DataFrame:
    """``coded`` with label_error, the sum of ``error`` over equal labels (nulls together).

    Sums are added up before they are shuffled. Labels that hold one row of ``sent_labels`` or more, at most so
    many, are sent to all executors; only rows of rarer ones are joined by a shuffle, so no task gets a hot label.
    """
    sums = Scratch(coded.sparkSession, "labels").save(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "sums")
    totals = sums.agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows")).first()
    out = [*coded.columns, "label_error"]
    sums = sums.withColumnRenamed("label", "of_label")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    if totals["labels"] <= sent_labels:
        return coded.join(F.broadcast(sums), same, "left").select(*out)
    hot = F.broadcast(sums.where(F.col("n") * sent_labels >= totals["rows"]))
    often = coded.join(hot, same).select(*out)
    seldom = coded.join(hot, same, "left_anti").join(sums, same).select(*out)
    return often.unionByName(seldom)
