"""Sources and sinks of the survey tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import md5_order, strip
from ..params import DEFAULTS
from ..schema import TABLES
from ..session import stage

#: Bits that tell which ids are looked for.
ID_BITS = 1 << 27

# Option weights of the demographic fields.
DEMOGRAPHICS = {
    "Program of study": [("Computer Science", 45), ("Information Technology", 30), ("Data Science", 15), ("International Program", 10)],
    "Year of study": [("Year 1", 20), ("Year 2", 30), ("Year 3", 30), ("Year 4", 20)],
    "Gender": [("Male", 55), ("Female", 40), ("Prefer not to say", 5)],
    "Age group": [("18–20", 45), ("21–23", 40), ("24–26", 10), ("27 or older", 5)],
}


def read_feedback_csv(spark: SparkSession, path: str, column: str = "raw_text") -> DataFrame:
    """A CSV with a header; quoted texts may span lines. Texts are stripped, blank rows dropped."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return rows.withColumn(column, strip(F.col(column))).where(F.col(column) != "")


def read_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of the survey model from Parquet, with their declared schemas."""
    return {n: spark.read.schema(TABLES[n]).parquet(f"{folder}/{n}.parquet") for n in names or TABLES}


def read_jdbc(spark: SparkSession, url: str, table: str, lower: int, upper: int, parts: int, column: str = "id", **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of its key."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=options)


def numbered(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """``df`` with consecutive numbers from 0 in the given order.

    Ranges are numbered by themselves and shifted by the counts of the ranges before, so no task
    sees more than its range.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    sorted_ = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = sorted_.groupBy("__range").count().collect()  # one row per range
    starts, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in counts):
        starts[part] = total
        total += n
    shifts = df.sparkSession.createDataFrame(list(starts.items()), "__range int, __shift long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    shifted = sorted_.withColumn(name, place).join(F.broadcast(shifts), "__range")
    return shifted.withColumn(name, (F.col(name) + F.col("__shift")).cast("long")).drop("__range", "__shift")


def rows_with(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose key is in ``ids`` (one column of whole numbers, which both have), without shuffling the others: for wide rows.

    A bit tells whether any id has a hash; the bits, 16 MB at most, are broadcast, in rows of 4 kB. What has the bit by
    chance is left out where the rows are joined.
    """
    (key,) = ids.columns
    place = F.pmod(F.xxhash64(key), F.lit(ID_BITS).cast("long")) + 1
    marked = ids.select(place.alias("p")).where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    met = rows.withColumn("__bucket", F.bitmap_bucket_number(place)).join(F.broadcast(stage(marked, "id-marks")), "__bucket")
    return met.where(held).select(*rows.columns)


def load_wave(rows: DataFrame, order: str, form_id: int, offset: int, limit: int, start: str, end: str, seed: int = DEFAULTS.seed, column: str = "raw_text") -> dict[str, DataFrame]:
    """Rows ``offset`` to ``offset + limit`` as submissions, text answers and option answers.

    Dates are start + span days * u^1.6 plus 8 to 19 hours and 0 to 59 minutes (early ones are more
    frequent); one option of each demographic field is drawn by weight. All draws come from hashes
    of seed and row, so a repeated load gives the same rows.
    """
    wave = numbered(rows, order).where((F.col("position") >= offset) & (F.col("position") < offset + limit))
    draw = lambda what: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("position")), F.lit(1_000_000).cast("long")) / 1_000_000.0
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date"))
    seconds = F.floor(days * F.pow(draw("day"), 1.6)) * 86400 + (8 + F.floor(draw("hour") * 12)) * 3600 + F.floor(draw("minute") * 60) * 60
    created = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + seconds)
    base = wave.select((F.col("position") + 1).alias("id"), F.left(F.col(column), F.lit(DEFAULTS.answer_length)).alias("answer_text"), created.alias("created_at"), "position")
    submissions = base.select("id", F.lit(form_id).cast("long").alias("form_id"), F.md5(F.concat_ws("|", F.lit(str(seed)), "id")).alias("anonymous_code"), F.lit("submitted").alias("submission_status"), "created_at")
    answers = base.select("id", F.col("id").alias("submission_id"), "answer_text", F.lit(None).cast("long").alias("answer_option_id"), "created_at", F.lit(None).cast("timestamp").alias("decomposed_at"))

    def choose(field: str, options: list[tuple[str, int]]) -> Column:
        total, below, out = sum(w for _, w in options), 0, None
        for label, weight in options:
            below += weight
            hit = draw(field) < below / total
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return out.otherwise(options[-1][0])

    options = base.select(F.col("id").alias("submission_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_label"), choose(f, o).alias("option_label")) for f, o in DEMOGRAPHICS.items()])).alias("o")).select("submission_id", "o.*")
    return {"submissions": submissions, "answers": answers, "option_answers": options}


def explode_points_json(df: DataFrame, id_col: str = "feedback_id", column: str = "points_json") -> DataFrame:
    """A row per element of the JSON list of strings, numbered from 0."""
    return df.select(id_col, F.posexplode(F.from_json(column, "array<string>")).alias("point_no", "point_text"))


def write_points_export(report: DataFrame, path: str) -> None:
    """The report's point table as CSV, without the answers' texts."""
    report.drop("answer_text").write.mode("overwrite").csv(path, header=True)


def backup_rows(df: DataFrame, path: str) -> None:
    """Save rows as JSON before a change that removes or overwrites them."""
    df.write.mode("errorifexists").json(path)


def write_decomposed(df: DataFrame, path: str) -> None:
    """One folder per prompt variant: feedback_id, raw_text, points_json, n_points, status."""
    out = df.select("variant", "feedback_id", "raw_text", F.to_json("points").alias("points_json"), F.size("points").alias("n_points"), "status")
    out.write.mode("overwrite").partitionBy("variant").parquet(path)


def run_record(forms: DataFrame, parameters: list[str], started: Column, completed: Column, model: str = "", status: str = "completed") -> DataFrame:
    """A row of the run log for each form, its parameters as JSON."""
    return forms.select(
        "form_id", F.lit(model).alias("model_name"), F.to_json(F.struct(*parameters)).alias("parameters"), F.lit(status).alias("status"),
        started.alias("started_at"), completed.alias("completed_at"),
    )


def record_run(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def _keyed_update(old: DataFrame, new: DataFrame, columns: dict[str, bool], key: str = "id") -> DataFrame:
    """``old`` with columns of ``new``; where the flag is set, a null keeps the old value."""
    fresh = new.select(F.col(key).alias("__key"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = old.join(fresh, F.col(key) == F.col("__key"), "left")
    for c, keep in columns.items():
        value = F.coalesce(f"__new_{c}", c) if keep else F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c))
        joined = joined.withColumn(c, value)
    return joined.select(*old.columns)


def update_point_features(points: DataFrame, new: DataFrame) -> DataFrame:
    """Embedding and labels; a null keeps the old value."""
    return _keyed_update(points, new, {c: True for c in ("embedding", "sentiment_label", "violation_status", "violation_type") if c in new.columns})


def update_point_labels(points: DataFrame, new: DataFrame) -> DataFrame:
    """Labels, overwritten even by nulls."""
    return _keyed_update(points, new, {c: False for c in ("sentiment_label", "violation_status", "violation_type") if c in new.columns})


def assign_points(points: DataFrame, assignments: DataFrame) -> DataFrame:
    """Status, topic and confidence of the assigned points, nulls included."""
    return _keyed_update(points, assignments, {c: False for c in ("processing_status", "canonical_topic_id", "assignment_confidence")})


def upsert_topics(topics: DataFrame, drafts: DataFrame, now: Column) -> DataFrame:
    """New topics and new values of old ones; created_at stays, and so does a summary that is not given."""
    old = topics.select(*[F.col(c).alias(f"__old_{c}") for c in topics.columns])
    joined = drafts.join(old, F.col("id") == F.col("__old_id"), "full")
    columns = []
    for c in topics.columns:
        if c == "updated_at":
            value = F.when(F.col("id").isNotNull(), now).otherwise(F.col("__old_updated_at"))
        elif c == "created_at":
            value = F.coalesce("__old_created_at", now)
        elif c not in drafts.columns:
            value = F.col(f"__old_{c}")
        elif c == "canonical_summary":
            value = F.coalesce(c, "__old_canonical_summary")
        else:
            value = F.when(F.col("id").isNotNull(), F.col(c)).otherwise(F.col(f"__old_{c}"))
        columns.append(value.alias(f"__out_{c}"))
    return joined.select(*columns).toDF(*topics.columns)


def write_by_form(df: DataFrame, path: str) -> None:
    """Replace the partitions of the forms in ``df`` and leave all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("form_id").parquet(path)
