"""Keyed updates of the point table as change files, merged when read.

A table is a folder ``base`` and a folder ``changes``, both partitioned by form. An update writes its own rows
only, with the number of the update; reading puts the changes of a point in order and lays them over its base
row. ``fold_in`` rewrites the forms whose changes have grown large. A base row knows the last update it holds, so
a fold that was interrupted, or repeated, changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each kind of update may set, and whether a null keeps the old value.
KINDS = {
    "features": (("embedding", "sentiment_label", "violation_status", "violation_type"), True),
    "labels": (("sentiment_label", "violation_status", "violation_type"), False),
    "assignment": (("processing_status", "canonical_topic_id", "assignment_confidence"), False),
}
_SETTABLE = list(dict.fromkeys(c for columns, _ in KINDS.values() for c in columns))
_APPLIED = "applied_update"


def create(points: DataFrame, path: str) -> None:
    """Write the base of a table; ``points`` has ``form_id`` and ``id``, which is unique within a form."""
    points.withColumn(_APPLIED, F.lit(0).cast("long")).write.mode("errorifexists").partitionBy("form_id").parquet(f"{path}/base")


def _schema(spark: SparkSession, path: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in spark.read.parquet(f"{path}/base").schema}


def _changes(spark: SparkSession, path: str) -> DataFrame | None:
    kinds = _schema(spark, path)
    schema = ", ".join(["id long", "update long", "kind string", "given array<string>", *(f"`{c}` {kinds[c]}" for c in _SETTABLE if c in kinds), f"form_id {kinds['form_id']}"])
    try:
        return spark.read.schema(schema).parquet(f"{path}/changes")
    except AnalysisException:
        return None


def write_change(new: DataFrame, path: str, kind: str, update: int) -> None:
    """Add an update (``form_id, id`` and the columns to set) under its number; numbers ascend from 1.

    Written under its number, so an update that is repeated replaces itself. Of rows that repeat an id, any one holds.
    """
    columns, _ = KINDS[kind]
    spark = new.sparkSession
    kinds = _schema(spark, path)
    given = [c for c in columns if c in new.columns]
    unknown = [c for c in new.columns if c not in ("form_id", "id", *columns)]
    if unknown or update < 1:
        raise ValueError(f"{kind} cannot set {unknown}" if unknown else "updates are numbered from 1")
    values = [(F.col(c) if c in given else F.lit(None)).cast(kinds[c]).alias(c) for c in _SETTABLE if c in kinds]
    rows = new.dropDuplicates(["form_id", "id"]).select("form_id", "id", F.lit(kind).alias("kind"), F.array(*map(F.lit, given)).cast("array<string>").alias("given"), *values, F.lit(update).cast("long").alias("update"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("form_id", "update").parquet(f"{path}/changes")


def _laid_over(column: str, base: Column) -> Column:
    """The value after all changes of a row, in the order of the updates."""

    def step(value: Column, change: Column) -> Column:
        keeps = change["kind"].isin([k for k, (_, keep) in KINDS.items() if keep])
        sets = F.array_contains(change["given"], column) & ~(keeps & change[column].isNull())
        return F.when(sets, change[column]).otherwise(value)

    return F.aggregate("__changes", base, step)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table with all updates; changes of points that the base does not have are ignored."""
    base = spark.read.parquet(f"{path}/base")
    changes = _changes(spark, path)
    columns = [c for c in base.columns if c != _APPLIED]
    if changes is None:
        return base.select(*columns)
    settable = [c for c in _SETTABLE if c in columns]
    # a point's changes: as many as updates that no fold has taken in
    listed = changes.groupBy("form_id", "id").agg(F.array_sort(F.collect_list(F.struct("update", "kind", "given", *settable))).alias("__changes"))
    joined = base.join(listed, ["form_id", "id"], "left").withColumn("__changes", F.filter("__changes", lambda c: c["update"] > F.col(_APPLIED)))
    return joined.select(*[F.when(F.col("__changes").isNull(), F.col(c)).otherwise(_laid_over(c, F.col(c))).alias(c) if c in settable else F.col(c) for c in columns])


def fold_in(spark: SparkSession, path: str, share: float = 0.1) -> list:
    """Rewrite the forms that have more changes than ``share`` of their points, and remove those changes; their form ids."""
    changes = _changes(spark, path)
    if changes is None:
        return []
    base = spark.read.parquet(f"{path}/base")
    counts = changes.groupBy("form_id").agg(F.count(F.lit(1)).alias("n"), F.max("update").alias("last")).join(base.groupBy("form_id").agg(F.count(F.lit(1)).alias("points")), "form_id")
    due = {r["form_id"]: r["last"] for r in counts.where(F.col("n") > F.col("points") * share).collect()}  # a row per form
    if not due:
        return []
    last = F.create_map(*[F.lit(x) for pair in due.items() for x in pair])
    merged = read(spark, path).where(F.col("form_id").isin(list(due))).withColumn(_APPLIED, last[F.col("form_id")].cast("long"))
    fresh = f"{path}/folding"
    merged.write.mode("overwrite").partitionBy("form_id").parquet(fresh)  # not over what is being read
    spark.read.schema(merged.schema).parquet(fresh).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("form_id").parquet(f"{path}/base")
    for form in due:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/changes/form_id={form}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return sorted(due)
