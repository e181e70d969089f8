"""Connected groups from bucketed candidates, without writing all pairs of a bucket.

A bucket holds the ids under one key; the smallest is its first. Each id is first paired with one
other: the first that it shares most buckets with. True links among those pairs join a group of
copies into one component, whatever its size. Links can then be missing only between members of a
bucket that still belong to different components, and only such pairs are looked at, so that no link
between two components is lost: within each bucket of at most ``HOT`` members, and in blocks of larger
ones (:func:`dealt`).

Buckets are counted by an aggregation that combines before the shuffle, and joined by key, so that
no key's rows have to pass one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import listed, stage

#: Members up to which a bucket is compared as it is.
HOT = 64
#: Members, and their weights in all, of a block of a larger bucket (on average).
BLOCK, BLOCK_WEIGHT = 1024, 2_000_000


def link_components(
    members: DataFrame, across: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], in_blocks: Callable[[DataFrame], DataFrame], name: str, weights: DataFrame | None = None,
    meet: Callable[[DataFrame], None] = lambda ids: None, deal: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``id, component`` of every id that has a link. Ids under no shared key do not appear.

    ``members`` has ``key`` and ``id``. ``verify`` takes pairs ``a, b`` (a < b, distinct) and returns
    the true links. ``across`` takes ``key, id, component`` and returns the true links between the
    members of a bucket whose components differ. ``in_blocks`` takes what :func:`dealt`
    gives and returns links that join all components which true links join. ``weights`` (``id,
    weight``) bounds the size of blocks. ``meet`` is called first with the ids that share a key with
    another. ``deal`` takes ``key, id, component`` of large buckets and deals them otherwise than :func:`dealt`.
    """
    # most keys have one member: what is shuffled for all of them is a key, its first id and a count
    sizes = stage(members.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), f"{name}-sizes")
    buckets = stage(members.join(listed(sizes.select("key")), "key", "left_semi").join(listed(sizes), "key"), f"{name}-buckets")
    meet(buckets.select("id").distinct())
    shared = buckets.where("first < id").groupBy("id", "first").agg(F.count(F.lit(1)).alias("c"))
    hubs = shared.groupBy("id").agg(F.max(F.struct("c", (-F.col("first")).alias("first"))).alias("best")).select((-F.col("best.first")).alias("a"), F.col("id").alias("b"))
    links = stage(verify(stage(hubs, f"{name}-hubs")), f"{name}-links")
    groups = connected_components(links)

    named = stage(buckets.join(groups, "id", "left").select("key", "id", "first", "n", F.coalesce("component", "id").alias("component")), f"{name}-named")
    split = stage(named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), f"{name}-split")
    apart = stage(named.join(listed(split), "key"), f"{name}-apart")
    more = stage(across(apart.where(F.col("n") <= HOT).select("key", "id", "component")), f"{name}-across")
    large = apart.where(F.col("n") > HOT)
    if not large.isEmpty():
        if not more.isEmpty():  # what the small buckets have joined need not be looked at again
            groups = connected_components(links.unionByName(more))
            large = large.drop("component").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
        more = more.unionByName(stage(in_blocks(stage(deal(large) if deal else dealt(large, weights), f"{name}-dealt")), f"{name}-blocks"))
    if more.isEmpty():
        return groups
    return connected_components(links.unionByName(more))


def dealt(large: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Rows of large buckets, dealt as pairs of blocks: ``group, i, j, left, id, component``.

    Buckets that share members are one group, so that no two members meet for each key again. The
    group's largest component needs no look at itself: the left sides are the members of all others,
    the right sides are all members. Members are copied once for each block on the other side.
    """
    group = connected_components(large.select(F.col("first").alias("a"), F.col("id").alias("b")))
    weight = F.lit(1.0) if weights is None else F.coalesce("weight", F.lit(1)) / F.lit(BLOCK_WEIGHT / BLOCK)
    grouped = large.select("id", "component").distinct().join(group.select("id", F.col("component").alias("group")), "id")
    if weights is not None:
        grouped = grouped.join(weights, "id", "left")
    grouped = stage(grouped.select("group", "id", "component", F.greatest(weight, F.lit(1.0)).alias("w")), "block-members")
    sums = grouped.groupBy("group", "component").agg(F.sum("w").alias("w")).groupBy("group")
    sums = sums.agg(F.sum("w").alias("all"), F.max(F.struct("w", "component")).alias("main")).where(F.col("all") > F.col("main.w"))
    placed = grouped.join(sums, "group").select(
        "group", "id", "component", F.xxhash64("id").alias("h"), (F.col("component") != F.col("main.component")).alias("other"),
        F.ceil((F.col("all") - F.col("main.w")) / BLOCK).alias("lefts"), F.ceil(F.col("all") / BLOCK).alias("rights"),
    )
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = placed.where("other").select("group", F.pmod("h", "lefts").alias("i"), to(F.col("rights")).alias("j"), F.lit(True).alias("left"), "id", "component")
    right = placed.select("group", to(F.col("lefts")).alias("i"), F.pmod("h", "rights").alias("j"), F.lit(False).alias("left"), "id", "component")
    return left.unionByName(right)
