"""Operator 2. Approximate nearest neighbours: an NN-descent graph and greedy search.

Equal vectors are one node. The graph starts from neighbours inside small random
groups. A round of NN-descent brings each node's neighbours and its nearest reverse
neighbours together (a join), compares them with each other, and offers each the
better ones, where one of the two is new to their meeting; each node keeps its K
nearest. Rounds end when less than a share CHANGED of all edges is new. A query starts
at its own node and expands, round by round, the best nodes of its pool that are not
expanded yet, along edges in both directions, all queries in the same joins, until no
more than a share SETTLED of the pools is open. Graph distances use vectors of 8-bit components with a
scale; the pool and the result use the original vectors in double precision.

Bounded by parameters, as the method samples: K neighbours and REVERSE reverse
neighbours of a node (so a hub of many nodes' lists is no large group), POOL nodes of a
query. Every vector is a node of the graph, and tables of all sizes take the same way.

Defined cases: null, zero, non-finite or null-holding vectors and vectors of another
than the commonest length take no part; a null id takes no part; rows that share an
id count once, with the smallest vector; equal distances go to the smaller id; with
fewer candidates than asked for all are returned; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pageloom.llm import textkit as tk
from pageloom.runtime import Scratch, ship

K, REVERSE, OFFERS = 32, 24, 16
#: Nodes of a random group; groupings; share of new edges that ends the rounds, and rounds at most.
GROUP, GROUPINGS, CHANGED, ROUNDS = 256, 2, 0.01, 20
#: Nodes of a query's pool, those expanded in a round, share of open nodes that ends the search, and rounds at most.
POOL, EXPAND, SETTLED, SEARCH_ROUNDS = 400, 100, 0.001, 40
FAR = float("inf")


def usable_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): the rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = "vec_id is not null and vec is not null and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(vec, x -> x <> 0)"
    rows = rows.where(fine).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    length = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (length[0]["n"] if length else 0))


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest different u of each v in ``edges(v, u, d, new)``; an edge that was there before isn't new."""
    once = edges.repartition("v").groupBy("v", "u").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return once.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("d", "u"))).where(f"r <= {k}").drop("r")


def pack(vectors: np.ndarray) -> list[bytes]:
    """Rows as a 32-bit scale and 8-bit components."""
    scale = np.maximum(np.abs(vectors).max(axis=1, initial=0) / 127, 1e-300)
    small = np.rint(vectors / scale[:, None]).astype(np.int8)
    return [s.tobytes() + r.tobytes() for s, r in zip(scale.astype(np.float32), small)]


def unpack(raw: np.ndarray) -> np.ndarray:
    """Vectors of packed rows (n, 4 + length) of bytes."""
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _packed_rows(column: pa.Array) -> np.ndarray:
    """A binary column of equal sizes as an array of bytes, without a copy."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].reshape(len(column), -1)


def _runs(batches, size: int):
    """Columns (arrays, the last one packed vectors) of rows of equal keys in the first column, as the partition is sorted by it; a group of more
    than ``size`` rows comes in parts. A run that reaches its batch's end waits for the next one."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [*(c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]), _packed_rows(batch.columns[-1])]
        if held is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(held, columns)]
        key = columns[0]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
            for low in range(a, b, size):
                yield [c[low : min(low + size, b)] for c in columns]
        held = [c[heads[-1] :] for c in columns]
    if held is not None:
        for low in range(0, len(held[0]), size):
            yield [c[low : low + size] for c in held]


def _offers(node: np.ndarray, x: np.ndarray, kth: np.ndarray, new: np.ndarray, most: int):
    """For each row its nearest others, where nearer than its kth and one of the two is new."""
    found = []
    norm = (x * x).sum(axis=1)
    most = min(most, len(node))
    for a in range(0, len(node), 1024):
        b = min(a + 1024, len(node))
        d = np.maximum(norm[a:b, None] + norm[None, :] - 2 * (x[a:b] @ x.T), 0)
        d[(node[a:b, None] == node[None, :]) | (d >= kth[a:b, None]) | ~(new[a:b, None] | new[None, :])] = FAR
        near = np.argpartition(d, most - 1, axis=1)[:, :most]
        value = np.take_along_axis(d, near, axis=1)
        v, c = np.nonzero(value < FAR)
        found.append((node[a + v], node[near[v, c]], value[v, c].astype(np.float64)))
    return tuple(map(np.concatenate, zip(*found)))


def _edge_batches(parts):
    for v, u, d in parts:
        if len(v):
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u), pa.array(d), pa.array(np.ones(len(v), dtype=bool))], ["v", "u", "d", "new"])


_EDGE = "v long, u long, d double, new boolean"


def build_graph(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes(node, small)`` to edges (v, u, d, new): about K near neighbours of every node."""
    n = nodes.count()
    groups, offers, changed = max(1, math.ceil(n / GROUP)), OFFERS, CHANGED * K * n

    @tk.releasing
    def inside(batches):
        def parts():
            for _, node, small in _runs(batches, 2 * GROUP):
                if len(node) > 1:
                    yield _offers(node, unpack(small), np.full(len(node), FAR), np.ones(len(node), dtype=bool), K)

        yield from _edge_batches(parts())

    edges = None
    for k in range(GROUPINGS):
        dealt = nodes.select(F.pmod(F.xxhash64("node", F.lit(k)), F.lit(groups)).alias("g"), "node", "small").repartition("g").sortWithinPartitions("g")
        part = dealt.mapInArrow(inside, _EDGE)
        edges = part if edges is None else edges.union(part)
    graph = scratch.save(_best(edges, K), "graph0")

    @tk.releasing
    def meet(batches):
        def parts():
            held = []
            for _, node, kth, new, small in _runs(batches, 1 + K + REVERSE):
                if len(node) > 1 and new.any():
                    held.append(_offers(node, unpack(small), kth, new, offers))
                if len(held) == 512:
                    yield tuple(map(np.concatenate, zip(*held)))
                    held = []
            if held:
                yield tuple(map(np.concatenate, zip(*held)))

        yield from _edge_batches(parts())

    for k in range(1, ROUNDS + 1):
        back = graph.select(F.col("u").alias("v"), F.col("v").alias("u"), "d", "new")
        back = back.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("d", "u"))).where(f"r <= {REVERSE}")
        # members of m: itself, its neighbours and its nearest reverse neighbours, each once
        member = graph.select("v", "u", "new").union(back.select("v", "u", "new")).union(nodes.select(F.col("node").alias("v"), F.col("node").alias("u"), F.lit(False)))
        member = member.groupBy(F.col("v").alias("m"), F.col("u").alias("node")).agg(F.max("new").alias("new"))
        # where nobody is new, all members have met before: only the others' vectors travel
        member = scratch.save(member, f"members{k}")
        member = member.join(member.where("new").select("m").distinct(), "m", "left_semi")
        kth = graph.groupBy(F.col("v").alias("node")).agg(F.when(F.count("*") >= K, F.max("d")).otherwise(F.lit(FAR)).alias("kth"))
        vectors = nodes.join(kth, "node", "left").select("node", F.coalesce("kth", F.lit(FAR)).alias("kth"), "small")
        met = member.join(vectors, "node").select("m", "node", "kth", "new", "small").repartition("m").sortWithinPartitions("m", "node").mapInArrow(meet, _EDGE)
        graph = scratch.save(_best(graph.withColumn("new", F.lit(False)).union(met), K), f"graph{k}")
        scratch.drop(f"graph{k - 1}", f"members{k}")
        if graph.where("new").count() <= changed:
            break
    return graph


def both_ways(graph: DataFrame) -> DataFrame:
    """(v, u): each node's neighbours and its REVERSE nearest reverse neighbours."""
    back = graph.select(F.col("u").alias("v"), F.col("v").alias("u"), "d").withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("d", "u"))).where(f"r <= {REVERSE}")
    return graph.select("v", "u").union(back.select("v", "u")).distinct()


def _with_distance(pairs: DataFrame) -> DataFrame:
    """``pairs(s, node, q, vec)`` to (s, node, d), Euclidean in double precision."""

    @tk.releasing
    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                q, vec = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sqrt(((q - vec) ** 2).sum(axis=1)))], ["s", "node", "d"])

    return pairs.select("s", "node", "q", "vec").mapInArrow(rows, "s long, node long, d double")


def nearest_neighbours(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, top: int = 10) -> DataFrame:
    """For each vector whose id is divisible by ``every``: its ``top`` nearest other rows found: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ann")
    rows = usable_vectors(table, id_col, vec_col)
    # of the ids of equal vectors the first top + 1 can be results; the limit applies before the shuffle too
    member = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(f"r <= {top + 1}")
    rows = scratch.save(rows, "rows")
    member = scratch.save(member.withColumn("node", F.min("vec_id").over(Window.partitionBy("vec"))), "member")

    def smaller(batches):
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pack(flat), pa.binary())], ["node", "small"])

    first = member.where("r = 1").select("node", "vec")
    nodes = scratch.save(first.mapInArrow(smaller, "node long, small binary"), "nodes")
    graph = build_graph(nodes, scratch)
    links = scratch.save(both_ways(graph), "links")

    queries = rows.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query_id"), "vec")
    queries = scratch.save(queries.join(first, "vec").select("query_id", "node", F.col("vec").alias("q")), "queries")
    # queries with equal vectors search once
    search = queries.groupBy("node").agg(F.first("q").alias("q"))
    pool = search.select(F.col("node").alias("s"), "node", F.lit(0.0).alias("d"), F.lit(False).alias("done"))
    ranked = Window.partitionBy("s").orderBy("d", "node")
    for k in range(SEARCH_ROUNDS):
        # its own node and everything it starts with are expanded first
        picked = pool.where("not done").withColumn("r", F.row_number().over(ranked)).where(f"r <= {EXPAND}").select("s", F.col("node").alias("v"))
        reached = picked.join(links, "v").select("s", F.col("u").alias("node")).distinct().join(pool.select("s", "node"), ["s", "node"], "left_anti")
        found = _with_distance(reached.join(first, "node").join(search.select(F.col("node").alias("s"), "q"), "s")).select("s", "node", "d", F.lit(False).alias("done"))
        known = pool.join(picked.select("s", F.col("v").alias("node"), F.lit(True).alias("now")), ["s", "node"], "left").select("s", "node", "d", F.expr("done or coalesce(now, false)").alias("done"))
        pool = scratch.save(known.union(found).withColumn("r", F.row_number().over(ranked)).where(f"r <= {POOL}").drop("r"), f"pool{k}")
        if k:
            scratch.drop(f"pool{k - 1}")
        if pool.where("not done").count() <= SETTLED * pool.count():
            break
    near = pool.join(member.select("node", "vec_id"), "node").select("s", "vec_id", "d")
    answers = queries.select("query_id", F.col("node").alias("s")).join(near, "s").where("vec_id <> query_id")
    ranks = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return answers.withColumn("rank", ranks).where(f"rank <= {top}").select("query_id", "rank", "vec_id", F.col("d").alias("score"))
