"""Connected components of an edge table, by hooking to the smallest neighbour and pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(v, root)`` for rows ``(v, r)``, ``r`` less than ``v``: every vertex of an edge with the least of its component.

    A vertex that is its component's least has no row. Each round, a vertex's least neighbour becomes its parent, its
    other neighbours are linked to that parent under their own parents, and parents are replaced by grandparents. Every
    edge only ever moves to lesser vertices, so the rounds end, and chains shorten exponentially. Repeated links are
    merged before they are shuffled; a vertex with very many children is on the side of the join that Spark can split.
    """
    edges = scratch.keep(edges.select("v", "r").where("r < v").distinct())
    mine = Window.partitionBy("v")
    while True:
        told = scratch.keep(edges.withColumn("u", F.min("r").over(mine)))
        if told.isEmpty():
            return told.select("v", F.col("u").alias("root"))
        parents = told.where("r = u").select(F.col("v").alias("r"), F.col("u").alias("p"))
        seen = scratch.keep(told.join(parents, "r", "left").select("v", "r", "u", "p"))
        if seen.where("r <> u or p is not null").isEmpty():
            return seen.select("v", F.col("u").alias("root"))
        up = F.coalesce("p", "r")
        # the parent's parent takes the parent's place; another neighbour is linked to the parent instead of to the vertex
        moved = seen.select(
            F.when(F.col("r") == F.col("u"), F.col("v")).otherwise(F.greatest(up, "u")).alias("v"),
            F.when(F.col("r") == F.col("u"), up).otherwise(F.least(up, "u")).alias("r"),
        )
        edges = moved.where("r < v").distinct()
