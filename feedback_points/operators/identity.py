"""Stable topic ids between runs, from shared members: joins and windows only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS


def containment(assignments: DataFrame, previous: DataFrame, topics: DataFrame) -> DataFrame:
    """``form_id, old_topic_id, topic_key, shared, old_size, share`` for old and new groups that overlap.

    ``assignments`` has form_id, id, topic_key (null for outliers); ``previous`` has id and
    old_topic_id. Old ids count only while the form still has the topic, and their size only
    members that are still in the corpus.
    """
    live = topics.select("form_id", F.col("id").alias("old_topic_id"))
    both = assignments.join(previous.where("old_topic_id is not null"), "id").join(live, ["form_id", "old_topic_id"], "left_semi")
    counted = both.groupBy("form_id", "old_topic_id", "topic_key").agg(F.count(F.lit(1)).alias("shared"))
    size = F.sum("shared").over(Window.partitionBy("form_id", "old_topic_id"))
    return counted.withColumn("old_size", size).where("topic_key is not null").withColumn("share", F.col("shared") / F.col("old_size"))


def claims(shares: DataFrame, carry_min: float = DEFAULTS.carry_min) -> DataFrame:
    """New groups that carry an old topic: each new group claims its best old one (share, then the
    smaller old id); of several claims the largest share, then most shared members, then the smaller
    key wins, and the losers become new."""
    best = F.row_number().over(Window.partitionBy("form_id", "topic_key").orderBy(F.desc("share"), "old_topic_id"))
    claim = shares.withColumn("__r", best).where((F.col("__r") == 1) & (F.col("share") >= carry_min)).drop("__r")
    winner = F.row_number().over(Window.partitionBy("form_id", "old_topic_id").orderBy(F.desc("share"), F.desc("shared"), "topic_key"))
    return claim.withColumn("__r", winner).where("__r = 1").drop("__r")


def merged(shares: DataFrame, carried: DataFrame, split_min: float = DEFAULTS.split_min) -> DataFrame:
    """Old topics that nobody carries, and the carried topic that took most of them."""
    keep = carried.select("form_id", "topic_key", F.col("old_topic_id").alias("survivor_id"))
    left = shares.join(carried.select("form_id", "old_topic_id"), ["form_id", "old_topic_id"], "left_anti")
    options = left.where(F.col("share") >= split_min).join(keep, ["form_id", "topic_key"])
    place = F.row_number().over(Window.partitionBy("form_id", "old_topic_id").orderBy(F.desc("share"), "survivor_id"))
    return options.withColumn("__r", place).where("__r = 1").select("form_id", "old_topic_id", "survivor_id", "share")


def split_events(shares: DataFrame, split_min: float = DEFAULTS.split_min) -> DataFrame:
    """Old topics of which more than one new group took a sizeable share."""
    return shares.where(F.col("share") >= split_min).groupBy("form_id", "old_topic_id").agg(F.count(F.lit(1)).alias("parts"), F.array_sort(F.collect_list("topic_key")).alias("topic_keys")).where("parts > 1")


def dissolved(topics: DataFrame, carried: DataFrame, absorbed: DataFrame) -> DataFrame:
    gone = carried.select("form_id", "old_topic_id").unionByName(absorbed.select("form_id", "old_topic_id"))
    return topics.select("form_id", F.col("id").alias("old_topic_id")).join(gone, ["form_id", "old_topic_id"], "left_anti")


@dataclass
class Identity:
    """What became of the old topics and where the new groups' ids come from."""

    carried: DataFrame
    merged: DataFrame
    split: DataFrame
    dissolved: DataFrame
    new: DataFrame


def resolve_identity(assignments: DataFrame, previous: DataFrame, topics: DataFrame, carry_min: float = DEFAULTS.carry_min, split_min: float = DEFAULTS.split_min) -> Identity:
    """Every old topic is carried, merged or dissolved; without previous topics all groups are new."""
    shares = containment(assignments, previous, topics)
    carried = claims(shares, carry_min)
    absorbed = merged(shares, carried, split_min)
    groups = assignments.where("topic_key is not null").select("form_id", "topic_key").distinct()
    new = groups.join(carried.select("form_id", "topic_key"), ["form_id", "topic_key"], "left_anti")
    return Identity(carried, absorbed, split_events(shares, split_min), dissolved(topics, carried, absorbed), new)


def outcomes(identity: Identity) -> DataFrame:
    """``form_id, outcome, topics``: counts of carried, merged, split, dissolved and new."""
    parts = [(identity.carried, "carried"), (identity.merged, "merged"), (identity.split, "split"), (identity.dissolved, "dissolved"), (identity.new, "new")]
    out = None
    for df, name in parts:
        own = df.groupBy("form_id").agg(F.count(F.lit(1)).alias("topics")).select("form_id", F.lit(name).alias("outcome"), "topics")
        out = own if out is None else out.unionByName(own)
    return out


def widened(identity: Identity) -> DataFrame:
    """Carried groups that took in another topic and so need a new name."""
    return identity.carried.join(identity.merged.select("form_id", F.col("survivor_id").alias("old_topic_id")).distinct(), ["form_id", "old_topic_id"], "left_semi")


def final_assignments(assignments: DataFrame, ids: DataFrame) -> DataFrame:
    """Points with their topic id; outliers, and groups without an id, are unknown with nulls."""
    joined = assignments.join(ids.select("form_id", "topic_key", "topic_id"), ["form_id", "topic_key"], "left")
    has = F.col("topic_id").isNotNull()
    return joined.select(
        "form_id", "id", F.when(has, "assigned").otherwise("unknown").alias("processing_status"), F.col("topic_id").alias("canonical_topic_id"), F.when(has, F.col("confidence")).alias("assignment_confidence"),
    )
