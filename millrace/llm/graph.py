"""Connected components as DataFrames: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges(a, b: bigint), undirected, to one row (node, component) per node; component is its least node.

    Each step replaces edges by edges to the least neighbour, so components become stars. Minima are
    combined before the shuffle and written out, so the join that uses them has an exchange on both sides
    and a node with very many edges can be split. Loops and repeated edges are allowed; no edges, no rows.
    """
    both = lambda e: e.select(F.col("a"), F.col("b")).union(e.select(F.col("b"), F.col("a")))
    pairs = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        # large star: larger neighbours of a node point to the least of it and its neighbours
        directed = both(pairs)
        least = checkpoint(directed.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = directed.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = checkpoint(large)
        # small star: a node and its smaller neighbours point to the least of them
        least = checkpoint(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        pairs = checkpoint(small)
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct())
