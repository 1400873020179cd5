"""Undirected connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pageloom.runtime import Scratch


def _large_star(e: DataFrame, keys: list[str]) -> DataFrame:
    """Every neighbour larger than a node is tied to the smallest of the node's neighbourhood."""
    both = e.select(*keys, "a", "b").union(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, [*keys, "a"]).where("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame, keys: list[str]) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = e.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy(*keys, "a").agg(F.min("b").alias("m"))
    return (
        down.join(low, [*keys, "a"])
        .select(*keys, F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("p"))
        .select(*keys, F.col("p.x").alias("a"), F.col("p.m").alias("b"))
        .where("a <> b")
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60, keys: Sequence[str] = ()) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``, the smallest node reachable; loops and repeats are harmless.

    With ``keys``, nodes of different keys are different (say, places of different images), and the keys are columns of the result too.
    Each round is written to the shared folder. The stars converge when their
    edge set no longer changes (compared by count and an order-free checksum).
    Nodes without an edge to another node are absent from the result.
    """
    spark, keys = edges.sparkSession, list(keys)
    scratch = Scratch(spark, "cc")
    now = scratch.save(edges.select(*keys, "a", "b").where("a <> b and a is not null and b is not null").distinct(), "0")
    if now.isEmpty():
        return spark.createDataFrame([], now.withColumnsRenamed({"a": "node", "b": "component"}).schema)
    seen = None
    for k in range(1, max_rounds + 1):
        now = scratch.save(_small_star(_large_star(now, keys), keys), str(k))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(str(k - 1))
        if seen == mark:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(*keys, F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(*keys, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
