"""Incremental ingest, due forms, retries and trends as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from ..operators.queue import waiting
from ..params import DEFAULTS


def answer_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 10) -> DataFrame:
    """Answers as files arrive, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _marked_before(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Answers that queries with other checkpoints have read; none before the first write."""
    try:
        return spark.read.schema("answer_id long, run string, batch long").parquet(path).where(F.col("run") != run).select("answer_id")
    except AnalysisException:
        return spark.createDataFrame([], "answer_id long")


def ingest_stream(answers: DataFrame, split: Callable[[DataFrame], DataFrame], points_path: str, marks_path: str, checkpoint: str):
    """Start a query that turns unread answers into points, each answer once.

    ``split`` gives ``answer_id, point_no, point_text, status`` of a batch. Which answers this query has read is the
    stream's own keyed state, so a batch looks up its own answers only, however many came before, and an answer is read
    whatever its date. The marks of queries with other checkpoints are read beside it; they do not grow while this query
    runs. A batch writes its points, then its marks, under its query's id and its own number and overwrites both on a
    replay, so a rerun never duplicates.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")  # stays the same for a checkpoint
        fresh = batch.join(_marked_before(spark, marks_path, run).withColumnRenamed("answer_id", "id"), "id", "left_anti").persist()
        try:
            for df, path in ((split(fresh), points_path), (fresh.select(F.col("id").alias("answer_id")), marks_path)):
                df.withColumn("run", F.lit(run)).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch").parquet(path)
        finally:
            fresh.unpersist()

    return waiting(answers).dropDuplicates(["id"]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quiet_forms_stream(points: DataFrame, minutes: int = DEFAULTS.quiet_minutes, late: str = "1 hour") -> DataFrame:
    """Bursts of pending points per form; a burst is emitted once no point followed for ``minutes``."""
    return points.withWatermark("created_at", late).groupBy("form_id", F.session_window("created_at", f"{minutes} minutes").alias("burst")).agg(F.count(F.lit(1)).alias("points")).select("form_id", F.col("burst.start").alias("started"), F.col("burst.end").alias("quiet_at"), "points")


def waiting_too_long_stream(points: DataFrame, minutes: int = DEFAULTS.max_wait_minutes, late: str = "1 hour") -> DataFrame:
    """A row per form when its oldest pending point has waited for ``minutes`` of event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (oldest,) = state.get
            state.remove()
            yield pd.DataFrame({"form_id": [key[0]], "oldest": [pd.Timestamp(oldest, unit="ms")]})
            return
        oldest = state.get[0] if state.exists else None
        for batch in batches:
            first = int(batch["created_at"].min().timestamp() * 1000)
            oldest = first if oldest is None else min(oldest, first)
        state.update((oldest,))
        state.setTimeoutTimestamp(max(oldest + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    return points.withWatermark("created_at", late).groupBy("form_id").applyInPandasWithState(step, "form_id long, oldest timestamp", "oldest long", "append", GroupStateTimeout.EventTimeTimeout)


def trend_stream(points: DataFrame, grain: str = "1 day", late: str = "1 day") -> DataFrame:
    """Points per topic and tumbling window; rows later than ``late`` are dropped."""
    return points.where("canonical_topic_id is not null").withWatermark("created_at", late).groupBy(F.window("created_at", grain).alias("w"), F.col("canonical_topic_id").alias("topic_id")).agg(F.count(F.lit(1)).alias("points")).select("topic_id", F.col("w.start").alias("period"), "points")


def retry_ledger(attempts: DataFrame, max_attempts: int = DEFAULTS.max_attempts) -> DataFrame:
    """Per answer: failures since its last success, and what follows (done, retry, keep_whole).

    ``attempts`` has answer_id, at, outcome (ok, failed, unreachable); an unreachable server is no
    failure of the answer.
    """
    good = attempts.where("outcome = 'ok'").groupBy("answer_id").agg(F.max("at").alias("last_ok"))
    joined = attempts.join(good, "answer_id", "left")
    since = F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok"))
    out = joined.groupBy("answer_id").agg(F.count(F.when(since & (F.col("outcome") == "failed"), 1)).alias("failures"), F.max("last_ok").alias("last_ok"), F.max("at").alias("last_at"))
    return out.withColumn("action", F.when(F.col("failures") >= max_attempts, "keep_whole").when(F.col("last_ok") == F.col("last_at"), "done").otherwise("retry")).select("answer_id", "failures", "action")


def retry_delay(failures: Column) -> Column:
    """Seconds before a form that failed so often in a row is tried again."""
    return F.least(30 * F.pow(F.lit(2.0), F.least(failures, F.lit(30))), F.lit(1200.0)).cast("long")
