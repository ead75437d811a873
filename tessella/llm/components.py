"""Connected components of an edge table by alternating large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import delete, written


def _turn(edges: DataFrame) -> DataFrame:
    """One large star, then one small star. edges: distinct (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _unfinished(edges: DataFrame) -> DataFrame:
    """Ids that still have two parents, or a parent and a child: none are left once all edges make stars."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (u, v): the smallest id that is reached from it.

    Edges may repeat and point either way; loops and edges with a null end count for nothing. Every turn is
    written to the shared folder and replaces the one before it; the number of turns is about the logarithm of
    the longest path.
    """
    u, v = F.col("u"), F.col("v")
    edges = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    edges = written(edges, "edges")
    while True:
        if not _unfinished(edges).limit(1).count():
            break
        new = written(_turn(edges), "edges")
        for path in {f.rsplit("/", 1)[0] for f in edges.inputFiles()}:
            delete(edges.sparkSession, path)
        edges = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
