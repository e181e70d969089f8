"""One hierarchy for many clusterings: a minimum spanning forest over mutual reachability distances.

A point's core distance is that to its ``min_pts``-th neighbour; the mutual reachability of a pair is the greatest of its
own distance and both core distances. The components of the pairs within a limit are those of a minimum
spanning forest's edges within it, so one forest serves every limit and every least size of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .components import connected_components


def core_distances(pairs: DataFrame, min_pts: int) -> DataFrame:
    """``id, core``: cosine distance of the ``min_pts``-th neighbour, of the points that have so many pairs."""
    both = pairs.select("a", "similarity").unionByName(pairs.select(F.col("b").alias("a"), "similarity"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity")))
    return both.withColumn("place", place).where(F.col("place") <= min_pts).where(F.col("place") == min_pts).select(F.col("a").alias("id"), (1 - F.col("similarity")).alias("core"))


def reachability(pairs: DataFrame, cores: DataFrame) -> DataFrame:
    """``form_id, a, b, weight`` of the pairs of points that have core distances."""
    own, other = (cores.select(F.col("id").alias(c), F.col("core").alias(f"core_{c}")) for c in "ab")
    return pairs.join(own, "a").join(other, "b").select("form_id", "a", "b", F.greatest(1 - F.col("similarity"), "core_a", "core_b").alias("weight"))


def _roots(parent: DataFrame) -> DataFrame:
    """``id, root`` of pointers ``id, parent`` whose only cycles are two components that point to each other; staged."""
    back = parent.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
    first = parent.join(back, "parent", "left").select("id", F.when((F.col("grand") == F.col("id")) & (F.col("id") < F.col("parent")), F.col("id")).otherwise(F.col("parent")).alias("root"))
    labels = stage(first, "roots")
    while True:
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("above"))
        moved = stage(labels.join(up, "root").select("id", F.col("root").alias("was"), F.col("above").alias("root")), "roots")
        labels = moved.select("id", "root")
        if moved.where("root != was").isEmpty():
            return labels


def spanning_forest(edges: DataFrame) -> DataFrame:
    """``form_id, a, b, weight``: the edges of a minimum spanning forest (staged); ties by the ends.

    Each round every component takes its least edge to another one (Boruvka), components that met become
    one, and of several edges between two components the least stays, so about log2(points) rounds remain of tables
    that at least halve.
    """
    least = F.min(F.struct("weight", "a", "b", "form_id")).alias("e")
    left = stage(edges.where("a != b").select("form_id", "a", "b", "weight", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).groupBy("x", "y").agg(least), "forest-edges")
    parts = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("y").alias("x"), F.col("x").alias("y"), "e"))
        best = stage(both.groupBy("x").agg(F.min(F.struct("e", "y")).alias("m")).select("x", "m.e", "m.y"), "least-edges")
        parts.append(best.select("e.form_id", "e.a", "e.b", "e.weight").distinct())
        roots = _roots(best.select(F.col("x").alias("id"), F.col("y").alias("parent")))
        ends = [roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "xy"]
        met = left.join(ends[0], "x").join(ends[1], "y").where("rx != ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y"), "e")
        left = stage(met.groupBy("x", "y").agg(F.min("e").alias("e")), "forest-edges")
    out = edges.select("form_id", "a", "b", "weight").where("false")
    for part in parts:
        out = out.unionByName(part)
    return stage(out, "forest")


def cut_forest(forest: DataFrame, cores: DataFrame, limits: DataFrame) -> DataFrame:
    """``form_id, limit_no, id, component`` of the core points at each limit (``form_id, limit_no, eps``) of their form.

    ``cores`` is ``form_id, id, core``; component is the smallest core point reached by edges within the limit.
    All limits are cut in one run: a point at a limit is a node of its own.
    """
    near = lambda c: F.col(c) <= F.col("eps") + 1e-12
    nodes = cores.join(limits, "form_id").where(near("core")).select("form_id", "limit_no", "id")
    nodes = stage(stage(nodes, "core-points").withColumn("node", F.monotonically_increasing_id()), "nodes")
    kept = forest.join(limits, "form_id").where(near("weight")).select("limit_no", "a", "b")
    ends = [nodes.select("limit_no", F.col("id").alias(c), F.col("node").alias(f"n{c}")) for c in "ab"]
    groups = connected_components(kept.join(ends[0], ["limit_no", "a"]).join(ends[1], ["limit_no", "b"]).select("na", "nb"), "na", "nb")
    joined = nodes.join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = joined.groupBy("component").agg(F.min("id").alias("first"))
    return joined.join(first, "component").select("form_id", "limit_no", "id", F.col("first").alias("component"))


def with_border(inner: DataFrame, pairs: DataFrame, limits: DataFrame) -> DataFrame:
    """``inner`` (from :func:`cut_forest`) and the points that are within their form's limit of a core point: in the
    group of the nearest one; ties by id."""
    both = pairs.select("form_id", "a", "b", "similarity").unionByName(pairs.select("form_id", F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    near = both.join(limits, "form_id").where(1 - F.col("similarity") <= F.col("eps") + 1e-12)
    core = inner.select("limit_no", F.col("id").alias("b"), "component")
    outside = near.join(inner.select("limit_no", F.col("id").alias("a")), ["limit_no", "a"], "left_anti").join(core, ["limit_no", "b"])
    nearest = outside.groupBy("form_id", "limit_no", "a").agg(F.min(F.struct((-F.round("similarity", 9)).alias("s"), "b", "component")).alias("m"))
    return inner.unionByName(nearest.select("form_id", "limit_no", F.col("a").alias("id"), F.col("m.component").alias("component")))
