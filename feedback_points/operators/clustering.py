"""Density clustering of points by form, and what is built on it.

Core points have at least ``min_pts`` neighbours within ``eps`` (by cosine distance), connected core
points form a group, a border point joins its nearest core point, small groups are noise (DBSCAN* of
Campello et al. 2013). Pairs of blocks are multiplied by tasks that send counts and links, never all pairs; groups come from connected components.
"""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS
from ..session import stage
from ..sources.io import numbered
from . import hierarchy
from .components import connected_components
from .neighbours import similar_pairs
from .report import cluster_size_stats
from .vectors import centroids, confidence, core_points, knn_join, min_cluster_size, near_links, plain_rows, radius_join, reassign_outliers
from .words import class_tfidf, npmi_by_topic, topic_diversity


def density_cluster(points: DataFrame, min_size: int, min_pts: int | None = None, eps: float | None = None, form: str = "form_id", id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """``form, id, label``: label -1 is noise; labels are numbered from 0 by their smallest id.

    ``eps`` is a cosine distance; None takes, per form, the median distance to the ``min_pts``-th
    neighbour. Groups smaller than ``min_size`` are noise, and so are points without a vector.
    """
    min_pts = min_pts or min_size
    base = stage(points.select(F.col(form).cast("long").alias("form_id"), F.col(id_col).cast("long").alias("id"), F.col(vector).alias("embedding")), "cluster-points")
    rows = plain_rows(base, "form_id", "id", "embedding").join(form_limits(base, min_pts, eps).select("form_id", (1 - F.col("eps")).alias("limit")), "form_id")
    core = core_points(rows, min_pts).select("form_id", F.col("id").alias("core"))
    flagged = rows.join(core.select("form_id", F.col("core").alias("id"), F.lit(True).alias("__c")), ["form_id", "id"], "left")
    found = stage(near_links(flagged.select(*rows.columns, F.coalesce("__c", F.lit(False)).alias("core"))), "links")
    return _clusters(base, core.select("core"), found, min_size)


def form_limits(base: DataFrame, min_pts: int, eps: float | None = None) -> DataFrame:
    """Each form's own limit (``form_id, eps``), staged.

    Without ``eps`` it is the median distance to the ``min_pts``-th neighbour; the median is exact up to
    10,000 points of a form, and within a ten-thousandth of ranks beyond.
    """
    if eps is not None:
        return stage(base.select("form_id").distinct().withColumn("eps", F.lit(float(eps))), "limits")
    kth = knn_join(base, min_pts).where(F.col("place") == min_pts)
    # euclidean distance d of unit vectors is a cosine distance of d*d/2
    median = F.percentile_approx("distance", 0.5, 10_000)
    return stage(kth.groupBy("form_id").agg((median * median / 2).alias("eps")), "limits")


def pair_graph(base: DataFrame, min_pts: int, eps: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs within each form's own limit (see :func:`form_limits`), and the limits; both staged."""
    limits = form_limits(base, min_pts, eps)
    return stage(radius_join(base, limits=limits.select("form_id", (1 - F.col("eps")).alias("limit"))), "pairs"), limits


def _clusters(base: DataFrame, core: DataFrame, found: DataFrame, min_size: int) -> DataFrame:
    """Labels from the core points and what :func:`.vectors.near_links` found."""
    groups = connected_components(found.where("similarity is null"), "id", "other")
    inner = core.join(groups, core.core == groups.id, "left").select(F.col("core").alias("id"), F.coalesce("component", "core").alias("component"))
    nearest = found.where("similarity is not null").groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "other")).alias("m")).select("id", F.col("m.other").alias("near"))
    outer = nearest.join(inner.withColumnRenamed("id", "near"), "near").select("id", "component")
    member = base.select("form_id", "id").join(inner.unionByName(outer), "id", "left")
    sized = member.where("component is not null").groupBy("form_id", "component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where(F.col("n") >= min_size)
    numbered = sized.withColumn("label", F.row_number().over(Window.partitionBy("form_id").orderBy("first")) - 1)
    return member.join(numbered.select("form_id", "component", "label"), ["form_id", "component"], "left").select("form_id", "id", F.coalesce("label", F.lit(-1)).cast("long").alias("label"))


def partition_cluster(points: DataFrame, k: int, seed: int = DEFAULTS.seed, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """Another backend, for one very large form: bisecting k-means, linear in the points."""
    rows = points.select(F.col(id_col).alias("id"), array_to_vector(F.col(vector)).alias("features"))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="label").fit(rows)
    return model.transform(rows).select("id", F.col("label").cast("long").alias("label"))


def topic_keys(labels: DataFrame) -> DataFrame:
    """Labels as string keys; noise becomes null."""
    return labels.select("form_id", "id", F.when(F.col("label") >= 0, F.col("label").cast("string")).alias("topic_key"))


def merge_near_duplicates(assignments: DataFrame, threshold: float = DEFAULTS.near_duplicate, pairs: DataFrame | None = None, index: bool = False) -> DataFrame:
    """Each group of near-identical points moves to the topic of its surest assigned member.

    ``assignments`` has form_id, id, embedding, topic_key (null: outlier), confidence. Groups are
    transitive; on equal confidence the smallest id decides; groups of outliers alone stay out.
    Moved members keep their confidence, rescued outliers get 0.0. Adds ``moved``. With ``index``, pairs come from
    :func:`.neighbours.similar_pairs`, for forms whose vectors are too many to be compared each with each.
    """
    if pairs is not None:
        found = pairs.where(F.col("similarity") >= threshold)
    else:
        found = similar_pairs(assignments, threshold) if index else radius_join(assignments, threshold)
    groups = connected_components(found)
    member = assignments.join(groups, "id", "left")
    home = (
        member.where("component is not null and topic_key is not null").groupBy("form_id", "component")
        .agg(F.min(F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), "id", "topic_key")).alias("h")).select("form_id", "component", F.col("h.topic_key").alias("home"))
    )
    out = member.join(home, ["form_id", "component"], "left")
    target = F.coalesce("home", "topic_key")
    return out.select(
        *[c for c in assignments.columns if c not in ("topic_key", "confidence")],
        target.alias("topic_key"), F.when(F.col("topic_key").isNull() & F.col("home").isNotNull(), 0.0).otherwise(F.col("confidence")).alias("confidence"),
        (~target.eqNullSafe(F.col("topic_key"))).alias("moved"),
    )


def touched_topics(moved: DataFrame, before: DataFrame) -> DataFrame:
    """Topics that lost or won a member and so need new counts, dates and means."""
    old = before.select("id", F.col("topic_key").alias("was"))
    rows = moved.where("moved").join(old, "id")
    return rows.select("form_id", F.explode(F.array("topic_key", "was")).alias("topic_key")).where("topic_key is not null").distinct()


def split_large_topics(assignments: DataFrame, min_size: int, min_pts: int | None = None, eps: float | None = None) -> DataFrame:
    """Topics of at least twice ``min_size`` members are clustered inside; parts get keys ``t.s``.

    A topic whose inside is all noise stays as it is. Leftover noise keeps the parent's key, unless
    it is less than ``min_size`` rows, which become outliers.
    """
    count = F.count("topic_key").over(Window.partitionBy("form_id", "topic_key"))
    sized = stage(assignments.withColumn("__n", F.when(F.col("topic_key").isNotNull(), count)), "sized")
    large = sized.where(F.col("__n") >= 2 * min_size)
    if large.isEmpty():
        return sized.drop("__n")
    names = stage(large.select("form_id", "topic_key").distinct(), "large-topics").withColumn("__group", F.monotonically_increasing_id())
    inside = large.join(names, ["form_id", "topic_key"]).select("__group", "id", "embedding")
    labels = density_cluster(inside, min_size, min_pts, eps, form="__group").select("id", F.col("label").alias("__label"))
    out = sized.join(labels, "id", "left")
    w = Window.partitionBy("form_id", "topic_key")
    parts, rest = F.max("__label").over(w), F.count(F.when(F.col("__label") == -1, 1)).over(w)
    key = (
        F.when(F.col("__label").isNull() | (F.col("__parts") < 0), F.col("topic_key")).when(F.col("__label") >= 0, F.concat_ws(".", "topic_key", F.col("__label").cast("string")))
        .when(F.col("__rest") < min_size, F.lit(None).cast("string")).otherwise(F.col("topic_key"))
    )
    return out.withColumn("__parts", parts).withColumn("__rest", rest).withColumn("topic_key", key).select(*assignments.columns)


#: Points whose place among sets of topics is broadcast.
PLACES = 1_000_000
#: Shares of the points that a sweep tries as least sizes of a group.
SWEEP_RATIOS = (0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1)


def sweep_sizes(n: Column, ratios: tuple[float, ...] = SWEEP_RATIOS) -> Column:
    """Candidate sizes for n points, ascending: at least 2, below half of the points."""
    sizes = F.array(*[F.greatest(F.lit(2), F.bround(n * F.lit(r)).cast("int")) for r in ratios])
    return F.filter(F.array_sort(F.array_distinct(sizes)), lambda m: m < F.floor(n / 2))


def parameter_sweep(points: DataFrame, sizes: list[int] | None = None, min_pts: int = DEFAULTS.knn, eps: float | None = None, text: str = "point_text", k: int = 10) -> DataFrame:
    """For each form and candidate size: ``n, topics, outlier_before, outlier_rate, largest_share, median_size, npmi, diversity``.

    Without ``sizes`` a form tries those of :func:`sweep_sizes`. All of them condense one spanning forest, cut at the form's
    limit (see :func:`pair_graph`): groups of fewer points are noise. ``outlier_before`` is the rate before outliers join the
    topic with the nearest mean, the rest is measured after that. Words of topics are their ``k`` first by class-based
    tf-idf; ``npmi`` is the mean over topics, null where none has two words. A size without topics has all points as outliers.
    """
    base = stage(points.select(F.col("form_id").cast("long").alias("form_id"), F.col("id").cast("long").alias("id"), "embedding", F.col(text).alias("text")), "sweep-points")
    tried = base.groupBy("form_id").agg(F.count(F.lit(1)).alias("n")).withColumn("sizes", F.array(*map(F.lit, sizes)) if sizes else sweep_sizes(F.col("n")))
    tried = stage(tried.select("form_id", F.explode(F.col("sizes").cast("array<int>")).alias("min_size")), "sweep-sizes")
    keys = stage(sweep_keys(base, tried, min_pts, eps), "sweep-keys")
    before = keys.groupBy("form_id", "min_size").agg(F.round(F.avg(F.col("topic_key").isNull().cast("double")), 6).alias("outlier_before"))
    # from here on a form at a size is a form of its own; texts stay apart, a row each whatever the number of sizes
    runs = stage(stage(tried, "runs").withColumn("run", F.monotonically_increasing_id()), "runs")
    own = keys.join(runs, ["form_id", "min_size"]).join(base.select("form_id", "id", "embedding"), ["form_id", "id"])
    own = own.select(F.col("run").alias("form_id"), F.col("form_id").alias("own_form"), "id", "topic_key", "embedding")
    kept = stage(reassign_outliers(own).drop("rescued", "embedding"), "sweep-labels")
    topics = kept.where("topic_key is not null").groupBy(F.col("own_form").alias("form_id"), "id").agg(F.array_sort(F.collect_list(F.struct("form_id", "topic_key"))).alias("topics"))  # at most one a size
    texts = base.select("form_id", "id", "text")
    top = stage(class_tfidf(_with_topics(texts, topics), "topic_key", k, form="form_id", members="topics"), "sweep-words")
    # all sizes of a form have the same texts, so their topics are looked up in them at once
    named_top = top.withColumnRenamed("form_id", "run").join(runs, "run").select("form_id", F.struct("run", "topic_key").alias("topic"), "term", "place")
    coherence = npmi_by_topic(named_top, texts, "topic", k=k, form="form_id").groupBy(F.col("topic.run").alias("form_id")).agg(F.avg("npmi").alias("npmi"))
    stats = cluster_size_stats(kept, ["form_id"]).join(coherence, "form_id", "left").join(topic_diversity(top, k, "form_id"), "form_id", "left")
    named = stats.withColumnRenamed("form_id", "run").join(runs, "run").join(before, ["form_id", "min_size"])
    return named.select("form_id", "min_size", "n", "topics", "outlier_before", "outlier_rate", "largest_share", "median_size", "npmi", "diversity")


def _with_topics(texts: DataFrame, topics: DataFrame) -> DataFrame:
    """``topics, text`` of the texts that have topics. Up to ``PLACES`` of them, texts are not written again: points have few different
    sets of topics, and the number of its set is broadcast for each."""
    sets = stage(stage(topics.select("topics").distinct(), "topic-sets").withColumn("set_no", F.monotonically_increasing_id()), "topic-sets")
    places = stage(topics.join(sets, "topics").select("form_id", "id", "set_no"), "topic-places")
    if places.count() > PLACES:
        return stage(texts.join(topics, ["form_id", "id"]).select("topics", "text"), "sweep-texts")
    return texts.join(F.broadcast(places), ["form_id", "id"]).join(F.broadcast(sets), "set_no").select("topics", "text")


def sweep_keys(base: DataFrame, tried: DataFrame, min_pts: int, eps: float | None = None) -> DataFrame:
    """``form_id, min_size, id, topic_key`` of all points at each tried size (``form_id, min_size``); noise has no key."""
    pairs, limits = pair_graph(base.select("form_id", "id", "embedding"), min_pts, eps)
    cores = stage(hierarchy.core_distances(pairs, min_pts).join(base.select("form_id", "id"), "id"), "core-distances")
    forest = hierarchy.spanning_forest(hierarchy.reachability(pairs, cores.select("id", "core")))
    one = limits.select("form_id", F.lit(0).alias("limit_no"), "eps")
    member = stage(hierarchy.with_border(stage(hierarchy.cut_forest(forest, cores, one), "cut"), pairs, one), "members")
    sized = member.groupBy("form_id", "component").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    large = tried.join(sized, "form_id").where("size >= min_size")
    numbered = large.withColumn("topic_key", (F.row_number().over(Window.partitionBy("form_id", "min_size").orderBy("first")) - 1).cast("string"))
    keyed = member.select("form_id", "id", "component").join(numbered.select("form_id", "min_size", "component", "topic_key"), ["form_id", "component"]).select("form_id", "min_size", "id", "topic_key")
    return base.select("form_id", "id").join(tried, "form_id").join(keyed, ["form_id", "min_size", "id"], "left").select("form_id", "min_size", "id", "topic_key")


def knn_purity(points: DataFrame, labels: DataFrame, k: int = DEFAULTS.knn) -> DataFrame:
    """Per form the mean share of a point's k neighbours with its label, noise left out; null when
    a form has at most k + 1 clustered points."""
    kept = points.join(labels.where(F.col("label") >= 0).select("id", "label"), "id")
    n = kept.groupBy("form_id").agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("vectors"), (F.min("label") == F.max("label")).alias("one"))
    near = knn_join(kept.join(n.where("not one").select("form_id"), "form_id", "left_semi"), k)  # where all have one label, so have all neighbours
    own = labels.select("id", "label")
    other = labels.select(F.col("id").alias("neighbour"), F.col("label").alias("other"))
    share = near.join(own, "id").join(other, "neighbour").groupBy("form_id", "id").agg(F.avg((F.col("label") == F.col("other")).cast("double")).alias("share"))
    purity = F.when(F.col("one") & (F.col("vectors") > 1), 1.0).otherwise(F.col("purity"))
    return n.join(share.groupBy("form_id").agg(F.avg("share").alias("purity")), "form_id", "left").select("form_id", F.when(F.col("n") > k + 1, purity).alias("purity"))


def growth_curve(prefixes: DataFrame, min_size: int, k: int = DEFAULTS.knn, eps: float | None = None) -> DataFrame:
    """Cluster statistics and purity of each prefix of ``labels.growth_prefixes``, as forms of their own."""
    staged = stage(prefixes, "prefixes")
    sizes = [r[0] for r in staged.select("fraction").distinct().orderBy("fraction").collect()]  # a handful
    fractions = F.array(*map(F.lit, sizes))
    placed = staged.withColumn("form_id", F.array_position(fractions, F.col("fraction")) - 1)
    # a point of each prefix is a point of its own, in the order of the ids
    own = stage(numbered(placed.select("form_id", "id", "embedding"), "id", name="__row").select("form_id", F.col("__row").alias("id"), "embedding"), "growth-points")
    labels = stage(density_cluster(own, min_size, eps=eps), "labels")
    row = cluster_size_stats(topic_keys(labels), ["form_id"]).join(knn_purity(own, labels, k), "form_id", "left")
    return row.withColumn("fraction", F.get(fractions, F.col("form_id").cast("int"))).drop("form_id")


__all__ = ["centroids", "confidence", "density_cluster", "form_limits", "growth_curve", "knn_purity", "merge_near_duplicates", "min_cluster_size", "pair_graph", "parameter_sweep", "partition_cluster", "split_large_topics", "sweep_keys", "sweep_sizes", "topic_keys", "touched_topics"]
