"""The labelling loop: sampling, hidden repeats, checks and merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_key, md5_order, strip
from ..params import DEFAULTS
from ..schema import CATEGORIES
from ..sources.io import numbered
from ..session import stage
from .queue import base_id

# Name, leaning to a violation, score from, score below, share of the sample.
BANDS = [
    ("flagged", True, 0.75, 1.01, 0.18),
    ("borderline", True, 0.50, 0.75, 0.22),
    ("weak-violation", True, 0.00, 0.50, 0.22),
    ("uncertain-none", False, 0.00, 0.60, 0.26),
    ("confident-none", False, 0.60, 1.01, 0.12),
]


def sample_n(df: DataFrame, n: int, seed: int = DEFAULTS.seed, id_col: str = "id") -> DataFrame:
    """A seeded sample of n rows, in id order."""
    return df.orderBy(md5_order(seed, id_col), id_col).limit(n).orderBy(id_col)


def limit_per_pass(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    return df.orderBy(id_col).limit(n)


def stratified_folds(df: DataFrame, strata: str, n: int = DEFAULTS.folds, seed: int = DEFAULTS.seed, id_col: str = "id") -> DataFrame:
    """A fold per row, dealt in random order within each stratum."""
    placed = numbered(df, strata, md5_order(seed, id_col), id_col, name="__at")
    starts = placed.groupBy(F.col(strata).alias("__of")).agg(F.min("__at").alias("__start"))  # a row for each stratum
    dealt = placed.join(starts, F.col(strata).eqNullSafe(F.col("__of")))
    return dealt.withColumn("fold", ((F.col("__at") - F.col("__start")) % n).cast("int")).drop("__at", "__of", "__start")


def holdout(df: DataFrame, n: int = DEFAULTS.folds) -> DataFrame:
    """Each row once per fold, as train or (in its own fold) eval."""
    out = df.withColumn("holdout", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("part", F.when(F.col("fold") == F.col("holdout"), "eval").otherwise("train"))


def band_of(category: Column, score: Column, bands: list = BANDS) -> Column:
    out = F.lit(None).cast("string")
    for name, leaning, lo, hi, _ in reversed(bands):
        out = F.when(((category != "none") == F.lit(leaning)) & (score >= lo) & (score < hi), name).otherwise(out)
    return out


def band_sample(pool: DataFrame, size: int = DEFAULTS.label_set_size, bands: list = BANDS, seed: int = DEFAULTS.seed, id_col: str = "id") -> DataFrame:
    """A sample with each band's share, drawn in random order within the band."""
    quota = F.lit(None).cast("int")
    for name, *_, share in bands:
        quota = F.when(F.col("band") == name, F.lit(round(size * share))).otherwise(quota)
    banded = pool.withColumn("band", band_of(F.col("category"), F.col("score"), bands)).where("band is not null")
    place = F.row_number().over(Window.partitionBy("band").orderBy(md5_order(seed, id_col), id_col))
    most = max(round(size * b[4]) for b in bands)  # a literal limit, so that each task drops the rest before the shuffle
    return banded.withColumn("__place", place).where(F.col("__place") <= most).where(F.col("__place") <= quota).drop("__place")


def band_shortage(sample: DataFrame, spark: SparkSession, size: int = DEFAULTS.label_set_size, bands: list = BANDS) -> DataFrame:
    """Per band: wanted, taken, missing."""
    wanted = spark.createDataFrame([(b[0], round(size * b[4])) for b in bands], "band string, wanted int")
    taken = sample.groupBy("band").agg(F.count(F.lit(1)).alias("taken"))
    return wanted.join(F.broadcast(taken), "band", "left").select("band", "wanted", F.coalesce("taken", F.lit(0)).alias("taken"), (F.col("wanted") - F.coalesce("taken", F.lit(0))).alias("missing"))


def insert_repeats(queue: DataFrame, repeats: int = DEFAULTS.repeats, gap: int = DEFAULTS.repeat_gap, seed: int = DEFAULTS.seed, id_col: str = "id", order: str = "position") -> DataFrame:
    """The queue with ``repeats`` rows shown again, ``gap`` places later, under id + ``#r``.

    Positions refer to the queue before any copy went in; the gap is capped at half the queue, and
    places beyond the end are at the end. The labelling queue is small: its numbers come from one window.
    """
    n = queue.count()
    if repeats > n:
        raise ValueError(f"{repeats} repeats asked for, but the queue has {n} rows")
    gap = max(1, min(gap, n // 2))
    base = numbered(queue, order, id_col, name="__at").withColumn(id_col, F.col(id_col).cast("string"))
    again = base.orderBy(md5_order(seed, id_col), id_col).limit(repeats)
    copies = again.withColumn("__key", F.least(F.col("__at") + gap, F.lit(n)) - 0.5).withColumn(id_col, F.concat(F.col(id_col), F.lit("#r")))
    both = base.withColumn("__key", F.col("__at").cast("double")).unionByName(copies)
    return numbered(both, "__key", id_col, name="queue_position").drop("__at", "__key")


def growth_prefixes(points: DataFrame, fractions: tuple[float, ...] = DEFAULTS.growth_fractions, seed: int = DEFAULTS.seed, id_col: str = "id") -> DataFrame:
    """Nested prefixes of one random order: a row per fraction and point."""
    placed = numbered(points.withColumn("__o", md5_order(seed, id_col)), "__o", id_col, name="__place")
    n = placed.count()
    sizes = F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(int(n * f)).alias("size")) for f in fractions])
    return placed.withColumn("__s", F.explode(sizes)).where(F.col("__place") < F.col("__s.size")).select(F.col("__s.fraction").alias("fraction"), *points.columns)


def chosen_label(override: Column, proposal: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(strip(override)), F.lit("")), F.lower(strip(proposal)))


def merge_labels(existing: DataFrame, review: DataFrame) -> DataFrame:
    """Existing rows, and reviewed ones whose text they do not hold: ``expected, text, stratum, source``.

    Texts are compared trimmed and lower-cased. A label outside the vocabulary fails the merge.
    """
    key = lambda c: F.lower(strip(F.col(c)))
    label = chosen_label(F.col("your_label"), F.col("proposed_label"))
    checked = F.when(label.isin(CATEGORIES), label).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))))
    have = existing.select(key("text").alias("__key"))
    fresh = review.withColumn("__key", key("text")).withColumn("expected", checked)
    new = stage(fresh.select("expected", "text", "stratum", F.lit("review").alias("source"), "__key"), "reviewed").join(have, "__key", "left_anti").drop("__key")
    old = existing.select("expected", "text", F.lit("existing").alias("stratum"), F.lit("existing").alias("source"))
    return old.unionByName(new)


def merge_report(existing: DataFrame, review: DataFrame) -> DataFrame:
    """One row: reviewed, overridden, already present."""
    have = existing.select(F.lower(strip(F.col("text"))).alias("__key")).distinct().withColumn("__have", F.lit(1))
    joined = review.withColumn("__key", F.lower(strip(F.col("text")))).join(have, "__key", "left")
    given = F.coalesce(F.lower(strip(F.col("your_label"))), F.lit(""))
    return joined.agg(
        F.count(F.lit(1)).alias("reviewed"), F.count(F.when((given != "") & (given != F.lower(strip(F.col("proposed_label")))), 1)).alias("overridden"), F.count("__have").alias("already_present"),
    )


def label_mix(merged: DataFrame) -> DataFrame:
    return merged.groupBy("expected").agg(F.count(F.lit(1)).alias("rows"))


def union_corpus(base: DataFrame, synthetic: DataFrame, order: str = "feedback_id") -> DataFrame:
    """Both corpora with new consecutive ids from 1, base first."""
    both = base.withColumn("__part", F.lit(0)).unionByName(synthetic.withColumn("__part", F.lit(1)))
    return numbered(both, "__part", order, name="__at").withColumn(order, F.col("__at") + 1).drop("__at", "__part")


def source_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


def review_sheet(flagged: DataFrame, ordinary: DataFrame, n_ordinary: int = 90, seed: int = DEFAULTS.seed, id_col: str = "id") -> DataFrame:
    """All flagged rows and a random part of the rest, numbered from 1, with default columns."""
    fill = [F.lit("").alias("your_label"), F.lit("").alias("note")]
    a = flagged.select(id_col, "text", "proposed_label", "confidence", *fill, F.lit("flagged").alias("stratum"), F.lit(True).alias("model_flagged"))
    b = ordinary.orderBy(md5_order(seed, id_col), id_col).limit(n_ordinary).select(id_col, "text", "proposed_label", "confidence", *fill, F.lit("random").alias("stratum"), F.lit(False).alias("model_flagged"))
    return numbered(a.unionByName(b), F.col("model_flagged").desc(), F.col(id_col), name="__at").withColumn("n", F.col("__at") + 1).drop("__at")


def review_counts(sheet: DataFrame) -> DataFrame:
    violation = F.col("proposed_label") != "none"
    return sheet.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(violation != F.col("model_flagged"), 1)).alias("disagreements"), F.count(F.when(F.col("confidence") != "high", 1)).alias("not_high"))


def label_counts(labels: DataFrame) -> DataFrame:
    """One row: labelled, positive, negative, unsure, positive rate of the decided."""
    is_ = lambda v: F.count(F.when(F.col("label") == v, 1))
    one, zero = is_("1"), is_("0")
    return labels.where("label is not null and label != ''").agg(
        F.count(F.lit(1)).alias("labelled"), one.alias("positive"), zero.alias("negative"), is_("unsure").alias("unsure"), F.round(F.try_divide(one.cast("double"), (one + zero).cast("double")), 6).alias("positive_rate"),
    )


def repeated_answers(labels: DataFrame) -> DataFrame:
    """Items answered more than once: how often, and whether always alike."""
    given = labels.where("label is not null and label != ''")
    return given.groupBy(base_id("id").alias("item")).agg(F.count(F.lit(1)).alias("answers"), (F.count_distinct("label") == 1).alias("consistent")).where("answers > 1")


def label_consistency(labels: DataFrame) -> DataFrame:
    """One row: repeated items, share answered alike, verdict."""
    out = repeated_answers(labels).agg(F.count(F.lit(1)).alias("repeated"), F.round(F.avg(F.col("consistent").cast("double")), 6).alias("share"))
    return out.withColumn("verdict", F.when(F.col("share") >= 0.85, "reliable").when(F.col("share") >= 0.75, "usable").when(F.col("share").isNotNull(), "unreliable"))


def decided(labels: DataFrame, order: str = "position") -> DataFrame:
    """The last decided label of each item."""
    given = labels.where(F.col("label").isin("0", "1"))
    return given.groupBy(base_id("id").alias("item")).agg(F.max_by(F.col("label").cast("int"), F.col(order)).alias("label"))


def _confusion(truth: Column, said: Column) -> list[Column]:
    n = lambda c: F.count(F.when(c, 1))
    tp, fp, fn, tn = n(truth & said), n(~truth & said), n(truth & ~said), n(~truth & ~said)
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1")]


def agreement(labels: DataFrame, pool: DataFrame, threshold: float = DEFAULTS.agreement_threshold, order: str = "position") -> DataFrame:
    """One row: score against the last decided labels; undefined shares are null."""
    joined = decided(labels, order).join(pool.select(F.col("id").cast("string").alias("item"), "score"), "item")
    return joined.agg(*_confusion(F.col("label") == 1, F.col("score") >= threshold))


def worst_disagreements(joined: DataFrame, threshold: float = DEFAULTS.agreement_threshold, n: int = 12) -> DataFrame:
    """False positives and false negatives with the largest scores, at most n of each kind."""
    kind = F.when((F.col("label") == 0) & (F.col("score") >= threshold), "false_positive").when((F.col("label") == 1) & (F.col("score") < threshold), "false_negative")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "item"))
    return joined.withColumn("kind", kind).where("kind is not null").withColumn("place", place).where(F.col("place") <= n)


def score_labelled(cases: DataFrame) -> DataFrame:
    """Each case with ``flag_correct`` and the kind of its mistake; needs expected, category, flagged."""
    truth = F.col("expected") != "none"
    right = truth == F.col("flagged")
    kind = F.when(truth & ~F.col("flagged"), "MISSED").when(~truth & F.col("flagged"), "FALSE POSITIVE").when(truth & (F.col("expected") != F.col("category")), "wrong category")
    return cases.withColumn("flag_correct", right).withColumn("kind", kind)


def score_summary(scored: DataFrame) -> DataFrame:
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return scored.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.col("flag_correct").cast("double")), 6).alias("accuracy"), n("MISSED").alias("missed"), n("FALSE POSITIVE").alias("false_positive"), n("wrong category").alias("wrong_category"))


def threshold_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 of ``score >= threshold`` against ``label``; one pass over the scores."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    return scores.withColumn("threshold", F.explode(grid)).groupBy("threshold").agg(*_confusion(F.col("label") == 1, F.col("score") >= F.col("threshold")))


def dedupe_by_key(new: DataFrame, existing: DataFrame, text: str = "raw_text", order: str = "feedback_id") -> DataFrame:
    """New rows whose content key neither the existing rows nor an earlier new row has."""
    have = existing.select(content_key(F.col(text)).alias("__key"))
    fresh = new.withColumn("__key", content_key(F.col(text))).join(have, "__key", "left_anti")
    place = F.row_number().over(Window.partitionBy("__key").orderBy(order))
    return fresh.withColumn("__place", place).where("__place = 1").drop("__place", "__key")
