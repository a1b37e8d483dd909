"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.llm import shared


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the least node of its component, for every node of an edge (a, b); edges to itself are ignored.

    Every round hangs neighbours on the least one they know: first of the larger neighbours, then of the smaller ones. The
    rounds, about the logarithm of the longest path, end when an edge table repeats. Each round's table is written to
    the shared folder. Only minima are taken over a node's edges, never lists.
    """
    now = shared.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _digest(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = shared.written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        before, state = state, _digest(now)
        if state == before:
            break
    least = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(least.select(F.col("v").alias("node"), F.col("v").alias("comp")))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
