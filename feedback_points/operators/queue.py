"""Selection of waiting answers, points and forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import narrated, strip
from ..params import DEFAULTS


def analysable_fields(fields: DataFrame) -> DataFrame:
    return fields.where("analyze_with_ai and deleted_at is null").select("id", "form_id")


def analysable_forms(forms: DataFrame, fields: DataFrame) -> DataFrame:
    """Forms with at least one analysable field."""
    return forms.join(analysable_fields(fields).select(F.col("form_id").alias("__form")), F.col("id") == F.col("__form"), "left_semi")


def waiting(answers: DataFrame) -> DataFrame:
    """Unread answers with text; blanks of any kind do not count as text."""
    return answers.where(F.col("decomposed_at").isNull() & F.col("answer_text").isNotNull() & (strip(F.col("answer_text")) != ""))


def pending_answers(answers: DataFrame, fields: DataFrame, per_field_limit: int | None = None) -> DataFrame:
    """Waiting answers of analysable fields; with a limit, the first of each field by id."""
    out = waiting(answers).join(analysable_fields(fields).select(F.col("id").alias("field_id")), "field_id", "left_semi")
    if per_field_limit is None:
        return out
    place = F.row_number().over(Window.partitionBy("field_id").orderBy("id"))
    return out.withColumn("__place", place).where(F.col("__place") <= per_field_limit).drop("__place")


def of_forms(points: DataFrame, answers: DataFrame, submissions: DataFrame, form_ids: list[int] | None) -> DataFrame:
    """Points whose answer belongs to one of the forms (all points when None)."""
    if form_ids is None:
        return points
    subs = submissions.where(F.col("form_id").isin(form_ids)).select(F.col("id").alias("submission_id"))
    own = answers.join(subs, "submission_id", "left_semi").select(F.col("id").alias("answer_id"))
    return points.join(own, "answer_id", "left_semi")


def points_missing_features(points: DataFrame, answers: DataFrame, submissions: DataFrame, form_ids: list[int] | None = None) -> DataFrame:
    return of_forms(points.where("embedding is null and point_text is not null"), answers, submissions, form_ids)


def points_for_relabel(points: DataFrame, answers: DataFrame, submissions: DataFrame, form_ids: list[int] | None = None) -> DataFrame:
    return of_forms(points.where("embedding is not null and point_text is not null"), answers, submissions, form_ids)


def point_ownership(points: DataFrame, answers: DataFrame, submissions: DataFrame) -> DataFrame:
    """Points with the submission and form that own them."""
    own = answers.select(F.col("id").alias("answer_id"), "submission_id")
    subs = submissions.select(F.col("id").alias("submission_id"), "form_id")
    return points.join(own, "answer_id").join(subs, "submission_id")


def is_violation(status: Column) -> Column:
    """Derived flag; null where the status is null."""
    return status.isin("possible", "violation")


def clusterable_points(points: DataFrame, answers: DataFrame, submissions: DataFrame, form_id: int | None = None) -> DataFrame:
    subs = submissions if form_id is None else submissions.where(F.col("form_id") == form_id)
    own = point_ownership(points.where("embedding is not null and point_text is not null"), answers, subs)
    return own.select("form_id", "id", "answer_id", "point_text", "embedding", "sentiment_label", is_violation(F.col("violation_status")).alias("is_violation"), "canonical_topic_id", "created_at")


def forms_with_unclustered(points: DataFrame, answers: DataFrame, submissions: DataFrame) -> DataFrame:
    """Forms with an embedded point that no run has seen; a null status counts as pending."""
    open_ = points.where("embedding is not null and coalesce(processing_status, 'pending') = 'pending'").select("answer_id")
    return point_ownership(open_, answers, submissions).select("form_id").distinct()


def all_decomposed(answers: DataFrame, ids: DataFrame) -> bool:
    """Whether none of the listed answers is still unread; true for no ids."""
    return answers.where("decomposed_at is null").join(ids.select("id"), "id", "left_semi").isEmpty()


def decomposed_lists(answers: DataFrame, lists: DataFrame) -> DataFrame:
    """The check of :func:`all_decomposed` for many lists at once: ``list_id, all_decomposed`` for every list of ``list_id, id``."""
    unread = answers.where("decomposed_at is null").select("id").withColumn("__unread", F.lit(True))
    return lists.join(unread, "id", "left").groupBy("list_id").agg((F.count("__unread") == 0).alias("all_decomposed"))


def base_id(column: str | Column) -> Column:
    """The part of a queue id before ``#``."""
    return F.split(column if isinstance(column, Column) else F.col(column), "#")[0]


def exclude_taken(pool: DataFrame, *label_files: DataFrame, id_col: str = "id") -> DataFrame:
    """Pool rows whose id no earlier label file holds."""
    taken = reduce(DataFrame.unionByName, [f.select(base_id("id").alias("__taken")) for f in label_files])
    return pool.join(taken, F.col(id_col).cast("string") == F.col("__taken"), "left_anti")


def drop_excluded_rows(df: DataFrame, needles: list[str], column: str = "raw_text", id_col: str = "feedback_id", boundary: int = 1000) -> DataFrame:
    """Rows without any of the needles, tagged violation (id from ``boundary`` up) or real."""
    hit = reduce(lambda a, b: a | b, [F.col(column).contains(n) for n in needles], F.lit(False))
    return df.where(~hit).withColumn("source", F.when(F.col(id_col) >= boundary, "violation").otherwise("real"))


def points_of_narrated_answers(points: DataFrame) -> DataFrame:
    """All points of every answer that has a narrated point."""
    hit = points.where(narrated(F.col("point_text"))).select("answer_id").distinct()
    return points.join(hit, "answer_id", "left_semi")


def ingest_backlog(answers: DataFrame, submissions: DataFrame, fields: DataFrame) -> DataFrame:
    """Waiting answers per form."""
    subs = submissions.select(F.col("id").alias("submission_id"), "form_id")
    return pending_answers(answers, fields).join(subs, "submission_id").groupBy("form_id").agg(F.count(F.lit(1)).alias("backlog"))


def readiness(points: DataFrame, answers: DataFrame, fields: DataFrame, submissions: DataFrame, now: Column) -> DataFrame:
    """Per form: pending points, waiting answers, minutes since the newest and oldest pending point."""
    minutes = lambda t: (F.unix_timestamp(now) - F.unix_timestamp(t)) / 60.0
    open_ = points.where("embedding is not null and coalesce(processing_status, 'pending') = 'pending'").select("answer_id", "created_at")
    pending = point_ownership(open_, answers, submissions).groupBy("form_id").agg(
        F.count(F.lit(1)).alias("pending_points"), minutes(F.max("created_at")).alias("minutes_since_newest"), minutes(F.min("created_at")).alias("minutes_since_oldest"),
    )
    both = pending.join(ingest_backlog(answers, submissions, fields), "form_id", "full")
    return both.select("form_id", F.coalesce("pending_points", F.lit(0)).alias("pending_points"), F.coalesce("backlog", F.lit(0)).alias("backlog"), "minutes_since_newest", "minutes_since_oldest")


def due_forms(ready: DataFrame, quiet: int = DEFAULTS.quiet_minutes, longest: int = DEFAULTS.max_wait_minutes) -> DataFrame:
    """Whether each form should be clustered now: waited too long, or quiet with nothing left to read."""
    due = (F.col("pending_points") > 0) & ((F.col("minutes_since_oldest") >= longest) | ((F.col("backlog") == 0) & (F.col("minutes_since_newest") >= quiet)))
    return ready.withColumn("due", F.coalesce(due, F.lit(False)))


def last_clustered(runs: DataFrame) -> DataFrame:
    return runs.groupBy("form_id").agg(F.max("completed_at").alias("last_clustered"))
