"""The workloads end to end: ingest, re-clustering, report and labelling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import topic_keywords, topic_name
from ..operators import clustering, identity, labels, queue, report, scoring, splitting, vectors, words
from ..params import DEFAULTS, Params
from ..session import stage


def ingest(answers: DataFrame, fields: DataFrame, responses: DataFrame, attempts: DataFrame, sentiment: scoring.Scorer, violation: scoring.Scorer, categories: dict[str, str], encoder: scoring.Scorer | None = None, params: Params = DEFAULTS, repairs: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Waiting answers to pending points with vectors and labels: ``answer_id, point_no, point_text, …``.

    ``categories`` names the category of each act that ``violation`` scores. ``repairs`` are the rewrites of narrated
    points (``answer_id, raw``), one table a pass; two are of use.
    """
    chunk = queue.pending_answers(answers, fields, params.answers_per_field)
    split = splitting.apply_split_responses(chunk, responses, attempts, params.max_attempts, params.short_answer_words)
    if repairs:
        split = splitting.accept_repair(split.join(chunk.select(F.col("id").alias("answer_id"), "answer_text"), "answer_id"), *repairs)
    rows = stage(splitting.point_rows(split), "points")
    scored = scoring.score_distinct(scoring.score_distinct(scoring.embed(rows, encoder), sentiment, "string", out="__s"), violation, "map<string,double>", out="__v")
    best = scoring.best_violation(F.col("__v"), categories, threshold=params.violation_flag)
    return scored.withColumn("__b", best).select(
        "answer_id", "point_no", "point_text", "status", "embedding", scoring.sentiment_label(F.col("__s")).alias("sentiment_label"),
        scoring.violation_status(F.col("__b.score"), F.col("__b.flagged"), params.violation_strong).alias("violation_status"), F.col("__b.category").alias("violation_type"), F.lit("pending").alias("processing_status"),
    )


@dataclass
class Clustered:
    """Results of a re-clustering run."""

    assignments: DataFrame
    topics: DataFrame
    identity: identity.Identity


def recluster(points: DataFrame, topics: DataFrame, min_size: int, eps: float | None = None, params: Params = DEFAULTS) -> Clustered:
    """Cluster the points of every form, rescue outliers, split large topics, merge near-duplicates,
    and carry old topic ids. ``points`` are clusterable points (:func:`queue.clusterable_points`)."""
    staged = stage(points, "clusterable")
    # a form with at most min_size points gets no topics
    per_form = staged.groupBy("form_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_size)
    enough = staged.join(per_form.select("form_id"), "form_id", "left_semi")
    keys = clustering.topic_keys(clustering.density_cluster(enough, min_size, eps=eps)).select("id", "topic_key")
    assigned = staged.join(keys, "id", "left")
    assigned = stage(vectors.reassign_outliers(assigned, params.outlier_similarity).drop("rescued"), "assigned")
    assigned = stage(clustering.split_large_topics(assigned, min_size, eps=eps), "split")
    means = vectors.centroids(assigned.where("topic_key is not null"), "form_id", "topic_key")
    sure = vectors.confidence(assigned.where("topic_key is not null"), means, "form_id", "topic_key")
    rest = assigned.where("topic_key is null").withColumn("confidence", F.lit(None).cast("double"))
    merged = stage(clustering.merge_near_duplicates(sure.select(*rest.columns).unionByName(rest), params.near_duplicate), "merged")

    previous = staged.select("id", F.col("canonical_topic_id").alias("old_topic_id"))
    who = identity.resolve_identity(merged.select("form_id", "id", "topic_key"), previous, topics, params.carry_min, params.split_min)
    top = topics.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = stage(who.new, "new").select("form_id", "topic_key", (F.monotonically_increasing_id() + top + 1).alias("topic_id"))
    ids = stage(who.carried.select("form_id", "topic_key", F.col("old_topic_id").alias("topic_id")).unionByName(fresh), "ids")
    named = words.class_tfidf(merged.where("topic_key is not null").withColumn("__t", F.concat_ws("/", "form_id", "topic_key")), "__t", text="point_text")
    listed = named.groupBy("__t").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda s: s["term"]).alias("words"))
    counts = report.draft_counts(merged.where("topic_key is not null"), "form_id", "topic_key").join(report.topic_dates(merged.where("topic_key is not null"), "form_id", "topic_key"), ["form_id", "topic_key"])
    drafts = (
        ids.join(counts, ["form_id", "topic_key"]).join(vectors.centroids(merged.where("topic_key is not null"), "form_id", "topic_key"), ["form_id", "topic_key"])
        .withColumn("__t", F.concat_ws("/", "form_id", "topic_key")).join(listed, "__t", "left").drop("__t")
        .withColumn("canonical_name", topic_name(F.col("words"))).withColumn("representative_keywords", topic_keywords(F.col("words")))
    )
    return Clustered(identity.final_assignments(merged, ids), drafts, who)


def topic_report(points: DataFrame, answers: DataFrame, topics: DataFrame, examples: int = 3) -> dict[str, DataFrame]:
    """Summary, ranked counts, examples and outliers."""
    return {
        "summary": report.corpus_summary(points),
        "counts": report.rank_topics(report.topic_counts(topics, points)),
        "points": report.points_report(points, answers, topics),
        "examples": report.top_examples(points.where("canonical_topic_id is not null").withColumnRenamed("canonical_topic_id", "topic_id"), examples),
        "outliers": points.where("processing_status = 'unknown'"),
    }


def label_queue(points: DataFrame, scored: DataFrame, earlier: list[DataFrame], params: Params = DEFAULTS) -> DataFrame:
    """The next labelling queue: distinct texts, minus those labelled before, sampled by band, with repeats."""
    pool = report.distinct_pool(points).withColumnRenamed("point_id", "id").join(scored.select("point_text", "score", "category"), "point_text")
    left = queue.exclude_taken(pool, *earlier) if earlier else pool
    sample = stage(labels.band_sample(left, params.label_set_size, seed=params.seed), "sample")
    ordered = sample.withColumn("position", F.row_number().over(labels.Window.orderBy(labels.md5_order(params.seed, "id"))))  # at most label_set_size rows
    repeats = min(params.repeats, sample.count())
    return labels.insert_repeats(ordered, repeats, params.repeat_gap, params.seed)


def due(points: DataFrame, answers: DataFrame, fields: DataFrame, submissions: DataFrame, now: Column, params: Params = DEFAULTS) -> DataFrame:
    """Forms to cluster now."""
    return queue.due_forms(queue.readiness(points, answers, fields, submissions, now), params.quiet_minutes, params.max_wait_minutes).where("due")
