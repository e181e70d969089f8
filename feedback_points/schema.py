"""Tables of the survey model, their closed vocabularies, and a check of both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMS = "id long, admin_id long, organization_id long, form_title string, form_description string, status string, access_type string, record_name boolean, one_response_per_person boolean, start_date timestamp, end_date timestamp"
FORM_FIELDS = "id long, form_id long, field_label string, field_type string, section string, is_required boolean, field_order int, analyze_with_ai boolean, deleted_at timestamp"
FIELD_OPTIONS = "id long, field_id long, option_label string, option_value string, option_order int, deleted_at timestamp"
SUBMISSIONS = "id long, form_id long, anonymous_code string, submission_status string, created_at timestamp"
ANSWERS = "id long, submission_id long, field_id long, answer_text string, answer_option_id long, created_at timestamp, decomposed_at timestamp"
POINTS = "id long, answer_id long, point_text string, embedding array<float>, sentiment_label string, violation_status string, violation_type string, processing_status string, canonical_topic_id long, assignment_confidence double, created_at timestamp"
TOPICS = "id long, form_id long, canonical_name string, canonical_summary string, representative_keywords string, centroid_vector array<float>, topic_size int, created_at timestamp, updated_at timestamp"
RUNS = "form_id long, model_name string, model_version string, embedding_model string, clustering_algorithm string, parameters string, status string, error string, started_at timestamp, completed_at timestamp"

TABLES = {
    "forms": FORMS, "form_fields": FORM_FIELDS, "field_options": FIELD_OPTIONS, "submissions": SUBMISSIONS,
    "answers": ANSWERS, "points": POINTS, "canonical_topics": TOPICS, "ai_model_runs": RUNS,
}

# The closed vocabularies of the survey model.
PROCESSING_STATUS = ["pending", "assigned", "unknown", "clustered"]
SENTIMENTS = ["positive", "neutral", "negative"]
VIOLATION_STATUS = ["none", "possible", "violation"]
CATEGORIES = ["legal", "ethics", "moral", "none"]


def vocabulary_faults(points: DataFrame) -> DataFrame:
    """``id, fault`` for each rule of the point table that a row breaks; a null counts as allowed."""
    topic = F.col("canonical_topic_id").isNotNull()
    rules = {
        "processing_status": ~F.col("processing_status").isin(PROCESSING_STATUS),
        "sentiment_label": ~F.col("sentiment_label").isin(SENTIMENTS),
        "violation_status": ~F.col("violation_status").isin(VIOLATION_STATUS),
        "assigned_topic": (F.coalesce("processing_status", F.lit("pending")) == "assigned") != topic,
        "labels_together": F.col("sentiment_label").isNull() != F.col("violation_status").isNull(),
    }
    found = [points.where(F.coalesce(bad, F.lit(False))).select("id", F.lit(name).alias("fault")) for name, bad in rules.items()]
    return reduce(DataFrame.unionByName, found)
