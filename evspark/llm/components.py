"""Connected components of an undirected edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import checkpoint


def components(edges: DataFrame, edges_a_task: int = 200_000) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Each round hangs every larger neighbour, then every smaller one, on a node's least neighbour, by
    grouped minima and joins; nothing is gathered. It ends when no edge changes. Edges with a null end and
    edges from a node to itself are left out; repeated edges count once; no edges give no rows; other
    columns are ignored.
    """
    pairs = checkpoint(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    size = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))]
    now, mark = pairs.agg(*size).first(), None
    while now != mark:
        tasks = 1 + now[0] // edges_a_task

        def packed(df: DataFrame, tasks: int = tasks) -> DataFrame:
            return df.coalesce(tasks)

        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = packed(large.where(F.col("a") != F.col("b"))).distinct()
        down = packed(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        pairs = checkpoint(packed(packed(small.union(low.select("a", F.col("m").alias("b")))).distinct()))
        now, mark = pairs.agg(*size).first(), now
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
