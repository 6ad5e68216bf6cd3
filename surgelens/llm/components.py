"""Connected components of an edge table by large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgelens.llm.common import stored


def _state(edges: DataFrame):
    """Number of edges and an order-free digest of them: one row."""
    r = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return r[0], r[1]


def _least(sides: DataFrame) -> DataFrame:
    """The smallest neighbour (or the node itself) of each node a; written, so that the join with
    the edges is between two exchanges and a hub's edges can be split over tasks."""
    return stored(sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "component-least").withColumnRenamed("a", "n")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    ``edges`` (a long, b long); self edges and repeats are allowed. Every round writes its tables, so
    the lineage stays short; the rounds end when the edges no longer change."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both)
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "component-large")
        least = _least(large)  # edges point to smaller nodes already
        small = large.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        now = stored(small, "component-edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
