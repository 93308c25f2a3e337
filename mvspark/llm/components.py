"""Connected components of an edge table by alternating star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, released


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: the larger neighbours of a node (large), or its smaller ones and itself, move to its least neighbour."""
    ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = ends.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = ends.join(least, "a").filter(F.col("b") > F.col("a")) if large else ends.join(least, "a")
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): root is the least node reachable. Each round's edges are checkpointed; it
    ends when the edges are stars, that is when a round changes none."""
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    now, mark = checkpointed(both), None
    while True:
        with released(edges.sparkSession):
            seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        now = checkpointed(_stars(_stars(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
