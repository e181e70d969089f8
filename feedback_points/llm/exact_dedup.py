"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, each range is sorted externally so that
equal texts stand side by side, and a window over equal neighbours (a comparison of the whole
texts) finds the row that stays. The splitters are pairs (first characters, id), so that a text
with very many copies is cut by id into several ranges. Only texts that begin like a splitter can
lie in more than one range; of those one row per range and text is brought together by the text
itself, and what was found goes back to the ranges.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stage

BLANKS = "[\\x20\\x09-\\x0D]+"
#: Characters of the normalised text that a splitter holds.
PREFIX = 48
#: Sampled rows for each range; the sample goes to the driver and is bounded by this times the ranges.
SAMPLED = 20
NO_ID = (1 << 63) - 1


def _range_of(key: Column, splitters: Column, n: int) -> Column:
    """How many splitters are not above ``key``: a binary search."""
    if n == 0:
        return F.lit(0)

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        at = F.get(splitters, mid)
        return (
            F.when(s["lo"] >= s["hi"], s)
            .when(at <= key, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi")))
            .otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, step)["lo"]


def _content_sort(docs: DataFrame, id_col: str, text_col: str, ranges: int | None, whole: bool) -> DataFrame:
    """``doc_id, keep, n, kept, text_sha256`` of every row, and with ``whole`` the row as a struct ``row``."""
    spark = docs.sparkSession
    ranges = ranges or 4 * shuffle_partitions(spark)
    norm_of = lambda text: F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")
    id_of = F.col(id_col).cast("long")
    sent = [F.struct("*").alias("row")] if whole else [norm_of(F.col(text_col)).alias("norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_cp")]
    base = docs.select(id_of.alias("doc_id"), F.coalesce(id_of, F.lit(NO_ID)).alias("rank_id"), F.left(norm_of(F.col(text_col)), F.lit(PREFIX)).alias("head"), *sent)

    n = docs.select(id_col).count()
    sample = base if n <= SAMPLED * ranges else docs.sample(min(1.0, SAMPLED * ranges / n), seed=7).select(
        F.left(norm_of(F.col(text_col)), F.lit(PREFIX)).alias("head"), F.coalesce(id_of, F.lit(NO_ID)).alias("rank_id"),
    )
    seen = sorted((r[0], r[1]) for r in sample.select("head", "rank_id").collect())
    cuts = sorted({seen[len(seen) * i // ranges] for i in range(1, ranges)}) if seen else []
    splitters = F.from_json(F.lit(json.dumps([{"h": h, "i": i} for h, i in cuts])), "array<struct<h:string,i:bigint>>")

    key = F.struct(F.col("head").alias("h"), F.col("rank_id").alias("i"))
    ranged = base.withColumn("range", _range_of(key, splitters, len(cuts)))
    begins_like = lambda at: F.coalesce(F.get(splitters, at)["h"] == F.col("head"), F.lit(False)) if cuts else F.lit(False)
    ranged = ranged.withColumn("spread", begins_like(F.col("range") - 1) | begins_like(F.col("range"))).drop("head").repartition(shuffle_partitions(spark), "range")
    if whole:
        text = F.col("row")[text_col]
        ranged = ranged.withColumns({"norm": norm_of(text), "n_cp": F.length(F.coalesce(text, F.lit("")))})
    equal = Window.partitionBy("range", "norm")
    first = equal.orderBy(F.desc("n_cp"), F.asc("rank_id"))
    place = F.row_number().over(first)
    local = stage(
        ranged.select(
            "doc_id", "range", "spread", place.alias("place"), F.first("rank_id").over(first).alias("keep"), F.first("n_cp").over(first).alias("keep_cp"), F.count(F.lit(1)).over(equal).alias("n"),
            F.sha2("norm", 256).alias("text_sha256"), F.when(F.col("spread") & (place == 1), F.col("norm")).alias("text"), *(["row"] if whole else []),
        ),
        "content-sort",
    )
    row = ["row"] if whole else []
    alone = local.where(~F.col("spread")).select("doc_id", "keep", "n", (F.col("place") == 1).alias("kept"), "text_sha256", *row)
    # one row per range and text, compared with the same text of the other ranges
    same = Window.partitionBy("text")
    best = F.first(F.struct("keep", "range")).over(same.orderBy(F.desc("keep_cp"), "keep"))
    over = local.where("spread and place = 1").select(F.col("range").alias("of_range"), F.col("text_sha256").alias("of_sha"), best.alias("best"), F.sum("n").over(same).alias("total"))
    spread = local.where("spread").join(over, (F.col("range") == F.col("of_range")) & (F.col("text_sha256") == F.col("of_sha")))
    spread = spread.select("doc_id", F.col("best.keep").alias("keep"), F.col("total").alias("n"), ((F.col("place") == 1) & (F.col("range") == F.col("best.range"))).alias("kept"), "text_sha256", *row)
    return alone.unionByName(spread)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical without blanks (space, tab to carriage return); a null text is
    an empty one, and empty texts are copies of each other. Of equal texts the one with the most
    code points, then the smallest id (null last) stays: exactly one row, also where ids are null or
    repeated. Other columns are ignored, so their names cannot clash. An empty table gives no rows.
    """
    found = _content_sort(docs, id_col, text_col, ranges, False)
    return found.select("doc_id", F.when(F.col("keep") != NO_ID, F.col("keep")).alias("keep_id"), F.col("n").alias("group_size"), "kept", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """``docs`` with one row of each text; see :func:`exact_groups`.

    Rows are judged one by one, whatever their ids: a text that no other row holds always stays, and
    of rows that repeat an id and a text one stays. Rows go through the sort whole, so none has to be
    found again by its id.
    """
    return _content_sort(docs, id_col, text_col, ranges, True).where("kept").select("row.*")
