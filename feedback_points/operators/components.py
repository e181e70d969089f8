"""Connected components of an edge table, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``id, component`` for every node of an undirected edge; component is the smallest id reachable.

    Each round but the first, which goes by id, mixes the order of the nodes anew. A node points to its first neighbour if that comes before itself, and
    what two such steps reach takes the node's place in the edges. A node of any degree comes before all of its
    neighbours in at most half of the orders, so the nodes left fall by a constant factor a round, about log2(nodes)
    rounds whatever the shape of the graph (trees and chains too). Pointers and edges are staged after each round.
    Self-loops and repeated edges are allowed; edges with a null end are ignored; no edges give
    no rows.
    """
    one_way = edges.select(F.col(src).cast("long").alias("x"), F.col(dst).cast("long").alias("y")).where("x is not null and y is not null")
    left = stage(one_way.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    levels = []
    while not left.isEmpty():
        levels.append(stage(_pointers(left, len(levels)), "pointers"))
        ends = [levels[-1].select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")) for c in "xy"]
        met = left.where("x != y").join(ends[0], "x").join(ends[1], "y").where("to_x != to_y")
        left = stage(met.select(F.least("to_x", "to_y").alias("x"), F.greatest("to_x", "to_y").alias("y")).distinct(), "edges")
    if not levels:
        return left.select(F.col("x").alias("id"), F.col("y").alias("component"))
    named = levels[-1]
    for level in reversed(levels[:-1]):  # from the few nodes of the last round to all
        named = level.join(named.select(F.col("id").alias("to"), F.col("to").alias("last")), "to", "left").select("id", F.coalesce("last", "to").alias("to"))
    named = stage(named, "roots")
    first = named.groupBy("to").agg(F.min("id").alias("component"))
    return stage(named.join(first, "to").select("id", "component"), "components")


def _pointers(edges: DataFrame, salt: int) -> DataFrame:
    """``id, to`` of every node of edges ``x, y``: two steps to the first neighbour (itself where none comes before)."""
    order = lambda c: F.struct((F.xxhash64(F.lit(salt), c) if salt else F.col(c)).alias("h"), F.col(c).alias("to"))
    both = edges.select("x", order("y").alias("o")).unionByName(edges.select(F.col("y").alias("x"), order("x").alias("o")))
    step = both.groupBy("x").agg(F.min("o").alias("o")).select(F.col("x").alias("id"), F.least("o", order("x"))["to"].alias("to"))
    return step.join(step.select(F.col("id").alias("to"), F.col("to").alias("two")), "to").select("id", F.col("two").alias("to"))
