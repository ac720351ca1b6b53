"""Connected components by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumetry.llm.tables import written
from albumetry.operators.scale import ROWS_PER_TASK, lookup_join


def _met(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``rows`` (u, v) with the least neighbour m of u; a hub with a large share of all edges is dealt out by v."""
    share = min(ROWS_PER_TASK, max(1_000, total // 1_024))  # hence at most 2,048 hubs, or total / ROWS_PER_TASK
    return lookup_join(rows, least, "u", "v", rows_per_task=share, how="inner").drop("n")


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the edges (u, v).

    Every node first hangs its larger neighbours onto its smallest one, then its smaller ones, until nothing changes; the
    number of rounds grows with the logarithm of the longest path. Each round is written, so no plan grows. Minima are
    formed map-side, so a node with very many edges sends one row per task, and its edges meet them in as many tasks as they need.
    """
    ends = edges.filter("u is not null and v is not null and u <> v")
    ends = ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(ends)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = written(_met(both.filter("v > u"), least, state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _met(large, least, state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
