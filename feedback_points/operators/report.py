"""Counts, examples and trends of topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS
from .queue import is_violation


def points_report(points: DataFrame, answers: DataFrame, topics: DataFrame) -> DataFrame:
    """The embedded points with their answer and, where there is one, their topic."""
    own = answers.select(F.col("id").alias("answer_id"), "answer_text")
    named = topics.select(F.col("id").alias("canonical_topic_id"), F.col("canonical_name").alias("topic_name"))
    return points.where("embedding is not null").join(own, "answer_id").join(named, "canonical_topic_id", "left").select(
        F.col("id").alias("point_id"), "answer_id", "answer_text", "point_text", "sentiment_label", is_violation(F.col("violation_status")).alias("is_violation"),
        F.col("canonical_topic_id").alias("topic_id"), "topic_name", "assignment_confidence", "processing_status", F.size("embedding").alias("embedding_dims"), "created_at",
    )


def topic_label(topic_id: Column, name: Column) -> Column:
    return F.coalesce(name, F.when(topic_id.isNotNull(), F.concat(F.lit("topic "), topic_id.cast("string"))), F.lit("unassigned"))


def empty_topics(topics: DataFrame, points: DataFrame) -> DataFrame:
    return topics.join(points.select(F.col("canonical_topic_id").alias("__topic")), F.col("id") == F.col("__topic"), "left_anti")


def live_topics(topics: DataFrame, points: DataFrame) -> DataFrame:
    return topics.join(points.select(F.col("canonical_topic_id").alias("__topic")), F.col("id") == F.col("__topic"), "left_semi")


def _tallies(sentiment: str, violation: Column) -> list[Column]:
    count = lambda cond: F.count(F.when(cond, 1))
    return [
        *[count(F.col(sentiment) == s).alias(f"{s}_count") for s in ("positive", "neutral", "negative")],
        count(violation).alias("violation_count"),
    ]


def topic_counts(topics: DataFrame, points: DataFrame) -> DataFrame:
    """Per topic: feedback, sentiment and violation counts; topics without points have zeros.

    Points are counted before they meet the topics, so one row per topic and task is shuffled.
    """
    counted = points.where("canonical_topic_id is not null").groupBy("canonical_topic_id").agg(F.count(F.lit(1)).alias("feedback_count"), *_tallies("sentiment_label", is_violation(F.col("violation_status"))))
    joined = topics.join(counted, F.col("id") == F.col("canonical_topic_id"), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("feedback_count", "positive_count", "neutral_count", "negative_count", "violation_count")]
    return joined.select(F.col("id").alias("topic_id"), "canonical_name", *zero)


def draft_counts(assignments: DataFrame, *keys: str) -> DataFrame:
    """Totals per draft topic; labels outside the vocabulary count in the total only."""
    return assignments.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_count"), *_tallies("sentiment_label", F.col("is_violation")))


def topic_dates(assignments: DataFrame, *keys: str) -> DataFrame:
    return assignments.groupBy(*keys).agg(F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def corpus_summary(points: DataFrame) -> DataFrame:
    """One row: answers, points, points per answer, vector sizes, topics, unclustered, sentiments, flagged."""
    per_answer = points.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("canonical_topic_id").isNull(), 1)).alias("open"),
        *[F.count(F.when(F.coalesce("sentiment_label", F.lit("NULL")) == s, 1)).alias(f"{s.lower()}_points") for s in ("positive", "neutral", "negative", "NULL")],
        F.count(F.when(is_violation(F.col("violation_status")), 1)).alias("flagged"),
    )
    totals = per_answer.agg(
        F.count(F.lit(1)).alias("answers"), F.sum("n").alias("points"), F.round(F.avg("n"), 6).alias("mean_points"), F.max("n").alias("max_points"), F.sum("open").alias("unclustered"),
        *[F.sum(f"{s}_points").alias(f"{s}_points") for s in ("positive", "neutral", "negative", "null")], F.sum("flagged").alias("flagged"),
    )
    shapes = points.agg(F.count_distinct(F.size("embedding")).alias("vector_sizes"), F.count_distinct("canonical_topic_id").alias("topics"))
    return totals.join(shapes)  # one row each


def distinct_pool(points: DataFrame) -> DataFrame:
    """One row per distinct text."""
    return points.groupBy("point_text").agg(F.min("id").alias("point_id"), F.min("form_id").alias("form_id"), F.count(F.lit(1)).alias("copies"))


def topic_reach(points: DataFrame, topic: str = "topic_id", respondent: str = "respondent_id") -> DataFrame:
    """Mentions, distinct respondents and their ratio per topic; ratios above 1.01 are inflated."""
    out = points.groupBy(topic).agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct(respondent).alias("reach"))
    ratio = F.try_divide(F.col("mentions").cast("double"), F.col("reach").cast("double"))
    return out.withColumn("inflation", ratio).withColumn("inflated", F.coalesce(ratio > 1.01, F.lit(False)))


def reach_totals(reach: DataFrame) -> DataFrame:
    return reach.agg(F.count(F.lit(1)).alias("topics"), F.sum("mentions").alias("mentions"), F.median("reach").alias("median_reach"), F.count(F.when(F.col("inflated"), 1)).alias("inflated_topics"))


def superseded_points(points: DataFrame) -> DataFrame:
    """Points older than the newest write of their answer; points as new as that one all survive."""
    newest = F.max("created_at").over(Window.partitionBy("answer_id"))
    return points.withColumn("__newest", newest).where(F.col("created_at") < F.col("__newest")).drop("__newest")


def newest_points(points: DataFrame) -> DataFrame:
    """Only the newest write of every answer."""
    newest = F.max("created_at").over(Window.partitionBy("answer_id"))
    return points.withColumn("__newest", newest).where("__newest is null or created_at is null or created_at >= __newest").drop("__newest")


def superseded_by_form(superseded: DataFrame) -> DataFrame:
    return superseded.groupBy("form_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("answer_id").alias("answers"))


def points_by_response(rows: DataFrame) -> DataFrame:
    """Ordered, trimmed, non-blank points of each response; a response has few points."""
    items = F.array_sort(F.collect_list(F.struct("sub_point_number", F.trim("sub_point_text").alias("text"))))
    listed = F.filter(F.transform(items, lambda x: x["text"]), lambda t: t != "")
    return rows.groupBy("original_feedback_id").agg(listed.alias("points"))


def gold_with_teacher(gold: DataFrame, teacher: DataFrame, source: DataFrame) -> DataFrame:
    """Gold and teacher lists side by side with the raw text; ``faulty`` marks rows without text or gold."""
    g = gold.select(F.col("original_feedback_id").alias("feedback_id"), F.col("points").alias("gold"))
    t = teacher.select(F.col("original_feedback_id").alias("feedback_id"), F.col("points").alias("teacher"))
    out = g.join(t, "feedback_id", "full").join(source, "feedback_id", "left")
    bad = F.col("raw_text").isNull() | (F.coalesce(F.size("gold"), F.lit(0)) <= 0)
    return out.withColumn("faulty", bad)


def gold_stats(lists: DataFrame, points: str = "points") -> DataFrame:
    n = F.size(points)
    return lists.agg(F.count(F.lit(1)).alias("responses"), F.round(F.avg(n), 6).alias("mean_points"), F.count(F.when(n == 1, 1)).alias("single"), F.count(F.when(n > 1, 1)).alias("multi"))


def points_histogram(lists: DataFrame, points: str = "points") -> DataFrame:
    return lists.groupBy(F.size(points).alias("n_points")).agg(F.count(F.lit(1)).alias("responses"))


def label_crosstab(df: DataFrame, label: str = "has_multiple_points", derived: str = "is_multi") -> DataFrame:
    """Counts of a label (null as a value of its own) against a derived flag."""
    return df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("NULL")).alias("label")).agg(
        F.count(F.when(F.col(derived), 1)).alias("multi"), F.count(F.when(~F.col(derived), 1)).alias("single"),
        F.count(F.when(F.col(label).cast("boolean") != F.col(derived), 1)).alias("mismatch"),
    )


def split_quality_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """Means of the split measures, and of the seconds a request took (``latency_s``) where they are known; nulls are left out
    of each mean."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 3).alias(c)
    latency = ["latency_s"] if "latency_s" in scores.columns else []
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[mean(c) for c in ("pred_n", "count_exact", "over_split", "under_split", "coverage", "fidelity", "pronoun_rate", *latency)],
        F.round(F.avg((F.col("status") == "parse_error").cast("double")), 3).alias("parse_error_rate"),
    )


def violation_tally(points: DataFrame) -> DataFrame:
    """One row: checked, flagged, rate, and a count of each category."""
    flag = is_violation(F.col("violation_status"))
    return points.where("violation_status is not null").agg(
        F.count(F.lit(1)).alias("checked"), F.count(F.when(flag, 1)).alias("flagged"), F.round(F.avg(flag.cast("double")), 6).alias("rate"),
        *[F.count(F.when(flag & (F.col("violation_type") == c), 1)).alias(f"{c}_count") for c in ("legal", "ethics", "moral")],
    )


def topic_trend(points: DataFrame, grain: str = "week", topic: str = "canonical_topic_id") -> DataFrame:
    return points.where(F.col(topic).isNotNull()).groupBy(F.col(topic).alias("topic_id"), F.date_trunc(grain, "created_at").alias("period")).agg(F.count(F.lit(1)).alias("points"))


def cluster_size_stats(assignments: DataFrame, by: list[str], topic: str = "topic_key") -> DataFrame:
    """Topics, outlier rate, largest share and median size; a null topic is an outlier."""
    sizes = assignments.groupBy(*by, topic).agg(F.count(F.lit(1)).alias("n"))
    inside = F.when(F.col(topic).isNotNull(), F.col("n"))
    total = F.sum("n")
    return sizes.groupBy(*by).agg(
        total.alias("n"), F.count(inside).alias("topics"), F.round(F.sum(F.when(F.col(topic).isNull(), F.col("n")).otherwise(0)) / total, 6).alias("outlier_rate"),
        F.round(F.max(inside) / total, 6).alias("largest_share"), F.median(inside).alias("median_size"),
    )


def top_examples(points: DataFrame, k: int = 3, topic: str = "topic_id", score: str = "assignment_confidence", id_col: str = "id") -> DataFrame:
    """The k surest members of each topic; equal scores by id, null scores last."""
    place = F.row_number().over(Window.partitionBy(topic).orderBy(F.col(score).desc_nulls_last(), F.col(id_col)))
    return points.withColumn("place", place).where(F.col("place") <= k)


def spread_examples(members: DataFrame, k: int = DEFAULTS.naming_examples, topic: str = "topic_id", text: str = "point_text", score: str = "assignment_confidence", id_col: str = "id") -> DataFrame:
    """Up to k members of each topic, evenly spaced from the surest to the least sure, texts once."""
    by_score = [F.col(score).desc_nulls_last(), F.col(id_col)]
    once = members.withColumn("__copy", F.row_number().over(Window.partitionBy(topic, text).orderBy(*by_score))).where("__copy = 1").drop("__copy")
    w = Window.partitionBy(topic)
    placed = once.withColumn("__i", F.row_number().over(w.orderBy(*by_score)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    steps = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / (k - 1)).cast("int")) if k > 1 else F.array(F.lit(0))
    return placed.where((F.col("__n") <= k) | F.array_contains(steps, F.col("__i"))).withColumn("place", F.col("__i")).drop("__i", "__n")


def rank_topics(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("feedback_count"), "topic_id")
