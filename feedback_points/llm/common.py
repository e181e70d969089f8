"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, stage, stage_path
from ..sources.io import numbered

__all__ = ["BROADCAST_IDS", "bounded_batches", "listed", "row_keys", "shared_dir", "shuffle_partitions", "stage", "stage_path", "with_ids", "without_ids"]

#: Rows of a list of single numbers that may be broadcast (about 50 bytes a row in memory); longer lists use a shuffle join.
BROADCAST_IDS = 1_000_000

#: Rows of an Arrow batch of texts; with 10,000 rows a batch of long texts takes much of a worker's memory.
BATCH_ROWS = 1000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering its session's Arrow batches to at most ``BATCH_ROWS`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def listed(keys: DataFrame) -> DataFrame:
    """``keys`` (a staged table of numbers), broadcast when it is counted and found short."""
    return F.broadcast(keys) if keys.count() * len(keys.columns) <= BROADCAST_IDS else keys


def _listed(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    ids = listed(stage(ids.select(F.col(id_col).cast("long").alias("__listed")).distinct(), "ids"))
    return docs.join(ids, F.col(id_col) == F.col("__listed"), how)


def row_keys(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells its rows apart, in the order of their ids; null where the id is.

    That is the id itself where no id is repeated, which is counted first; else ``docs`` is written with numbers.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    if ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return docs, id_col
    order = F.col(id_col).cast("long")
    placed = numbered(docs, order, name="__row").withColumn("__row", F.when(order.isNotNull(), F.col("__row")))
    return stage(placed, "numbered-rows"), "__row"


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``dropped``; rows with a null id stay.

    The id list is broadcast only when it is counted and found short.
    """
    return _listed(docs, dropped, id_col, "left_anti")


def with_ids(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is in ``wanted``."""
    return _listed(docs, wanted, id_col, "left_semi")
