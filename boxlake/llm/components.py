"""Connected components of an edge table, by alternating star contraction over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _lowest(edges: DataFrame) -> DataFrame:
    """Each node u of directed edges (u, v) with m, the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _with_lowest(edges: DataFrame) -> DataFrame:
    # The hash as a second key makes the join deal both sides anew, so that Spark can split a node of very many edges.
    h = F.xxhash64("u")
    return edges.withColumn("h", h).join(_lowest(edges).withColumn("h", h), ["u", "h"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u long, v long): root is the least node of its component.

    Large-star and small-star steps alternate until nothing changes, which takes about log(n)^2 rounds at most.
    Loops, repeated edges and an empty table are fine; edges with a null end are ignored. Nothing is collected.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-star")
        down = _with_lowest(large)
        small = down.select("u", F.col("m").alias("v")).union(down.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "small-star")
        if (now := mark(edges)) == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
