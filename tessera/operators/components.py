"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.cut import cut, small


def _nearest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of each u; partial sums make a hub cheap. Cut, so that the join after it can be split where u is hot."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")))


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) for every node of edges (u, v), component being the smallest node that can be reached.

    Self-loops keep their node; null ends are dropped; repeated edges count once. Each round is a grouped minimum
    and a join, and is written to the shared checkpoint folder; no edge list goes to the driver or into one task.
    The rounds go on until nothing changes; their number grows with the logarithm of the number of nodes. With a bound on them,
    a graph that needs more raises an error.
    """
    edges = edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    loops = edges.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    tree = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for n in itertools.count():
        now = tree.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) % 1000003"))).first()
        if now == before or not now[0]:
            break
        if n == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        before = now
        both = tree.unionAll(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = small(_nearest(both))
        large = cut(both.join(near, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        near = small(_nearest(large))
        joined = large.join(near, "u")
        tree = cut(joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct())
    roots = tree.select(F.col("v").alias("node")).distinct()
    found = tree.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
    return found.unionAll(loops.distinct().join(found, "node", "left_anti"))
