"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelry.llm.stores import stored

#: First rounds that take the ids as they are ordered.
PLAIN_ROUNDS = 2


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each id on an edge (a, b) the smallest id that it can reach.

    Each round maps every node to the least of itself and its neighbours and renames the edges, until
    none is left. The first rounds take the order of the ids, which ends at once for components whose
    least id has all the others as neighbours; the later ones a random order, in which the number of
    edges falls by a constant factor, whatever the shape. Minima are combined before they are shuffled, so a node with very many edges is no
    burden. NULL ends and loops say nothing about others; a loop still names its node.
    """
    edges = stored(edges.toDF("a", "b").where("a IS NOT NULL AND b IS NOT NULL"), "edges")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    maps, left = [], edges.where("a <> b")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        if len(maps) < PLAIN_ROUNDS:
            least = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"))
            step = least.select("id", F.least("id", "least").alias("to"))
        else:
            order = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))
            least = both.groupBy(F.col("a").alias("id")).agg(F.min(order).alias("least"))
            own = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("id"))
            step = least.select("id", F.least(own, "least")["id"].alias("to"))
        step = stored(step, "step")
        maps.append(step)
        renamed = left.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b")
        left = stored(renamed.where("x <> y").select("x", "y").toDF("a", "b").distinct(), "edges")
    named = nodes.select("id", F.col("id").alias("root"))
    for step in maps:
        moved = named.join(step.toDF("root", "to"), "root", "left")
        named = moved.select("id", F.coalesce("to", "root").alias("root"))
    named = stored(named, "named")
    if len(maps) <= PLAIN_ROUNDS:  # the root is the least id
        return named.withColumnRenamed("root", "component")
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    return stored(named.join(least, "root").select("id", "component"), "components")
