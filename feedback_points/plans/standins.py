"""The survey tables as read from the benchmark tables, in Spark and, for the twins, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points with a unique id."""
    k = F.get_json_object("props", "$.k").cast("long")
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("event_id") % 1500).alias("answer_id"), F.concat_ws(" ", "event_type", k).alias("point_text"),
        F.when(F.col("event_id") % 9 != 0, F.array(value.cast("float"))).alias("embedding"),
        F.when(F.col("event_type") == "click", "positive").when(F.col("event_type") == "view", "neutral").when(F.col("event_type") == "error", "negative").when(F.col("event_type") == "signup", "mixed").alias("sentiment_label"),
        F.when(value < 20, "none").when(value < 60, "possible").when(value < 100, "violation").alias("violation_status"),
        F.when(k % 4 == 0, "legal").when(k % 4 == 1, "ethics").when(k % 4 == 2, "moral").otherwise("none").alias("violation_type"),
        F.when(k % 4 == 0, "pending").when(k % 4 == 1, "assigned").when(k % 4 == 2, "unknown").alias("processing_status"),
        F.when(k < 60, k).alias("canonical_topic_id"), F.round(value / 500, 4).alias("assignment_confidence"), F.col("ts").alias("created_at"),
    )


def wide_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points without a unique id."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("answer_id"), (F.col("l_partkey") % 50).alias("canonical_topic_id"), F.col("l_suppkey").alias("respondent_id"),
        F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "N", "neutral").otherwise("negative").alias("sentiment_label"),
        F.when(F.col("l_discount") < 0.03, "none").when(F.col("l_discount") < 0.07, "possible").otherwise("violation").alias("violation_status"),
        F.col("l_shipdate").alias("created_at"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("submission_id"), (F.col("o_custkey") % 25).alias("field_id"),
        F.when(key % 11 == 0, None).when(key % 13 == 0, "  ").when(key % 17 == 0, "\n").otherwise(F.concat("o_orderpriority", F.lit(", order "), key.cast("string"))).alias("answer_text"),
        F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("decomposed_at"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).cast("long").alias("form_id"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(
        key.alias("id"), F.col("n_regionkey").cast("long").alias("form_id"), (key % 4 != 3).alias("analyze_with_ai"), F.when(key % 7 == 6, F.lit("2020-01-01").cast("timestamp")).alias("deleted_at"),
    )


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("form_title"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).alias("form_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("canonical_name"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' labels as a labelling queue in which every fifth item is asked twice."""
    base = table(spark, sf_dir, "labels").select(
        F.col("doc_id"), F.when(F.col("doc_id") % 10 == 7, "unsure").otherwise(F.col("toxic").cast("string")).alias("label"), F.col("quality"),
    )
    once = base.select(F.col("doc_id").cast("string").alias("id"), "label", F.col("doc_id").alias("position"))
    again = base.where("doc_id % 5 = 0").select(F.concat(F.col("doc_id").cast("string"), F.lit("#r")).alias("id"), F.when(F.col("doc_id") % 25 == 0, F.col("quality").cast("string")).otherwise(F.col("label")).alias("label"), (F.col("doc_id") + 1_000_000_000).alias("position"))
    return once.unionByName(again)


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a made-up score and category."""
    score = F.round(F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 1000.0, 3)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", score.alias("score"), F.when(F.col("doc_id") % 3 == 0, "none").when(F.col("doc_id") % 3 == 1, "legal").otherwise("moral").alias("category"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("form_id"), F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("topic_key"))


SQL = {
    "points": """points AS (SELECT event_id AS id, event_id % 1500 AS answer_id, event_type || ' ' || k AS point_text, event_id % 9 <> 0 AS embedded,
        CASE event_type WHEN 'click' THEN 'positive' WHEN 'view' THEN 'neutral' WHEN 'error' THEN 'negative' WHEN 'signup' THEN 'mixed' END AS sentiment_label,
        CASE WHEN value < 20 THEN 'none' WHEN value < 60 THEN 'possible' WHEN value < 100 THEN 'violation' END AS violation_status,
        CASE k % 4 WHEN 0 THEN 'legal' WHEN 1 THEN 'ethics' WHEN 2 THEN 'moral' ELSE 'none' END AS violation_type,
        CASE k % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'assigned' WHEN 2 THEN 'unknown' END AS processing_status,
        CASE WHEN k < 60 THEN k END AS canonical_topic_id, round(value / 500, 4) AS assignment_confidence, ts AS created_at
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))""",
    "wide": """wide AS (SELECT l_orderkey AS answer_id, l_partkey % 50 AS canonical_topic_id, l_suppkey AS respondent_id,
        CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'N' THEN 'neutral' ELSE 'negative' END AS sentiment_label,
        CASE WHEN l_discount < 0.03 THEN 'none' WHEN l_discount < 0.07 THEN 'possible' ELSE 'violation' END AS violation_status, l_shipdate AS created_at FROM lineitem)""",
    "answers": """answers AS (SELECT o_orderkey AS id, o_custkey AS submission_id, o_custkey % 25 AS field_id,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '  ' WHEN o_orderkey % 17 = 0 THEN chr(10) ELSE o_orderpriority || ', order ' || o_orderkey END AS answer_text,
        o_orderdate AS created_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS decomposed_at FROM orders)""",
    "submissions": "submissions AS (SELECT c_custkey AS id, CAST(c_nationkey % 5 AS BIGINT) AS form_id FROM customer)",
    "fields": """fields AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS form_id, n_nationkey % 4 <> 3 AS analyze_with_ai,
        CASE WHEN n_nationkey % 7 = 6 THEN TIMESTAMP '2020-01-01' END AS deleted_at FROM nation)""",
    "forms": "forms AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS form_title FROM region)",
    "topics": "topics AS (SELECT p_partkey AS id, p_partkey % 5 AS form_id, p_name || ' ' || p_partkey AS canonical_name FROM part)",
    "queue": """queue AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 10 = 7 THEN 'unsure' ELSE CAST(toxic AS VARCHAR) END AS label, doc_id AS position FROM labels
        UNION ALL SELECT doc_id || '#r', CASE WHEN doc_id % 25 = 0 THEN CAST(quality AS VARCHAR) WHEN doc_id % 10 = 7 THEN 'unsure' ELSE CAST(toxic AS VARCHAR) END, doc_id + 1000000000 FROM labels WHERE doc_id % 5 = 0)""",
    "pool": """pool AS (SELECT doc_id AS id, text, source, round((doc_id * 7919 % 1000) / 1000.0, 3) AS score,
        CASE doc_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'legal' ELSE 'moral' END AS category FROM documents)""",
    "vectors": "vectors AS (SELECT vec_id % 5 AS form_id, vec_id AS id, embedding, CAST(label AS VARCHAR) AS topic_key FROM embeddings)",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
