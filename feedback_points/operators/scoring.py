"""Batch scoring of texts by a pluggable model, and the rules that turn scores into labels.

Models are not part of the library: a scorer is any function from a list of texts to a list of
values, made once per Python worker. The defaults here are small deterministic stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.text import strip
from ..params import DEFAULTS
from ..schema import SENTIMENTS
from ..sources.io import update_point_features, update_point_labels
from .queue import points_for_relabel, points_missing_features

Scorer = Callable[[list[str]], list]


def score_distinct(df: DataFrame, make: Callable[[], Scorer], kind: str, text: str = "point_text", out: str = "score", batch: int = DEFAULTS.scoring_batch) -> DataFrame:
    """``df`` with the scorer's value of every text; each distinct text is scored once.

    ``kind`` is the value's SQL type. Null texts get null. Distinct texts are spread evenly by row.
    """
    arrow_kind = to_arrow_type(StructType.fromDDL(f"x {kind}")["x"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for records in batches:
            texts = records.column(0).to_pylist()
            values = [v for i in range(0, len(texts), batch) for v in score(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([records.column(0), pa.array(values, arrow_kind)], ["__text", out])

    distinct = df.where(F.col(text).isNotNull()).select(F.col(text).alias("__text")).distinct()
    scored = distinct.mapInArrow(run, f"__text string, {out} {kind}")
    return df.join(scored, F.col(text) == F.col("__text"), "left").drop("__text")


def hashing_encoder(dims: int = 384) -> Callable[[], Scorer]:
    """Unit vectors of signed word hashes; a text without words is a zero vector."""

    def make() -> Scorer:
        import zlib

        def encode(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = np.zeros(dims, np.float32)
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % dims] += 1.0 if h >> 16 & 1 else -1.0
                n = float(np.linalg.norm(v))
                out.append((v / n if n else v).tolist())
            return out

        return encode

    return make


def word_scorer(words: dict[str, str], default: str | None = None) -> Callable[[], Scorer]:
    """The value of the first listed word that a text holds."""

    def make() -> Scorer:
        return lambda texts: [next((v for w, v in words.items() if w in t.lower()), default) for t in texts]

    return make


def embed(df: DataFrame, encoder: Callable[[], Scorer] | None = None, text: str = "point_text", out: str = "embedding") -> DataFrame:
    return score_distinct(df, encoder or hashing_encoder(), "array<float>", text, out)


def sentiment_label(label: Column) -> Column:
    """Lower-cased and trimmed; null outside the vocabulary."""
    clean = F.lower(strip(label))
    return F.when(clean.isin(SENTIMENTS), clean)


def best_violation(scores: Column, categories: dict[str, str], threshold: float = DEFAULTS.violation_flag) -> Column:
    """Struct of score, flagged, category from independent scores by act (a map); ties by act name.

    ``categories`` names each act's category (none where it is not listed). Without scores: 0, false, none.
    """
    table = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair]) if categories else F.create_map().cast("map<string,string>")
    ranked = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("act"))))
    best = F.get(ranked, F.lit(0))
    score = F.coalesce(-best["s"], F.lit(0.0))
    flagged = score >= threshold
    return F.struct(score.alias("score"), flagged.alias("flagged"), F.when(flagged, F.coalesce(F.try_element_at(table, best["act"]), F.lit("none"))).otherwise("none").alias("category"))


def violation_status(score: Column, flagged: Column, strong: float = DEFAULTS.violation_strong) -> Column:
    """none, possible or violation; strength is judged on the score rounded to three decimals."""
    return F.when(flagged.isNull(), None).when(~flagged, "none").when(F.round(score, 3) >= strong, "violation").otherwise("possible")


def toxicity_flag(scores: Column, threshold: float = DEFAULTS.toxicity) -> Column:
    """Whether any score of a map reaches the threshold."""
    return F.coalesce(F.array_max(F.map_values(scores)) >= threshold, F.lit(False))


def _labels(points: DataFrame, sentiment: Callable[[], Scorer] | None, violation: Callable[[], Scorer], categories: dict[str, str], threshold: float) -> DataFrame:
    """``id, sentiment_label, violation_status, violation_type``; the scorers give a label and a map of scores."""
    scored = points.select("id", "point_text").withColumn("__sentiment", F.lit(None).cast("string"))
    if sentiment is not None:
        scored = score_distinct(points.select("id", "point_text"), sentiment, "string", out="__sentiment")
    scored = score_distinct(scored, violation, "map<string,double>", out="__scores")
    best = best_violation(F.col("__scores"), categories, threshold)
    return scored.withColumn("__best", best).select(
        "id", sentiment_label(F.col("__sentiment")).alias("sentiment_label"), violation_status(F.col("__best.score"), F.col("__best.flagged")).alias("violation_status"), F.col("__best.category").alias("violation_type"),
    )


def relabel(
    points: DataFrame, answers: DataFrame, submissions: DataFrame, sentiment: Callable[[], Scorer], violation: Callable[[], Scorer], categories: dict[str, str], form_ids: list[int] | None = None, threshold: float = DEFAULTS.violation_flag,
) -> DataFrame:
    """Points with fresh labels for those that have an embedding; labels are overwritten even by nulls.

    ``categories`` names the category of each act that ``violation`` scores.
    """
    return update_point_labels(points, _labels(points_for_relabel(points, answers, submissions, form_ids), sentiment, violation, categories, threshold))


def backfill(
    points: DataFrame, answers: DataFrame, submissions: DataFrame, sentiment: Callable[[], Scorer] | None, violation: Callable[[], Scorer], categories: dict[str, str] | None = None,
    encoder: Callable[[], Scorer] | None = None, form_ids: list[int] | None = None, threshold: float = DEFAULTS.violation_flag,
) -> DataFrame:
    """Points with features where the embedding was missing; those become pending. Without a
    sentiment scorer both labels stay null."""
    missing = points_missing_features(points, answers, submissions, form_ids)
    new = embed(missing.select("id", "point_text"), encoder)
    if sentiment is not None:
        new = new.join(_labels(missing, sentiment, violation, categories or {}, threshold), "id")
    updated = update_point_features(points, new)
    hit = missing.select(F.col("id").alias("__id"))
    return updated.join(hit, F.col("id") == F.col("__id"), "left").withColumn("processing_status", F.when(F.col("__id").isNotNull(), "pending").otherwise(F.col("processing_status"))).drop("__id")
