"""Vector operators: means, cosines, similar pairs and nearest neighbours.

Pairs and neighbours are found by blocks: rows of a form get a block number, each pair of blocks is
one group of bounded size, and a group multiplies its two blocks tile by tile. A form of any size is spread
over blocks, so no task holds a whole form. A row is sent once a block of its form, so blocks are few: as many as
give enough tasks, and more only where a block would have over ``NUMBERS`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS
from ..session import stage
from .components import connected_components

#: Vectors in the blocks of a form that is small enough for at most ``BLOCKS`` of them.
BLOCK = 1024
BLOCKS = 8
#: Numbers in a block at most: 65,536 vectors of 64 numbers.
NUMBERS = 1 << 22
#: Cosines that a task makes at once.
TILE = 1 << 21
#: Vectors that a row is compared with before the next ones, and rows at once, where nearest ones are kept.
WIDE, HIGH = 2048, 1024
#: Points of a form that all others are compared with first, and points of a group that are.
PROBES, PROBED = 4096, 8192


def fit_dims(vector: Column, n: int) -> Column:
    """A vector of n numbers: zeros on the right of a shorter one; a longer one is an error."""
    pad = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(n) - F.size(vector), F.lit(0)))
    return F.when(F.size(vector) > n, F.raise_error(F.lit("vector is wider than the column"))).otherwise(F.concat(vector, pad))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zeros."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column) -> Column:
    """Of length one; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


def centroids(assignments: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per key, not normalised; the aggregation's buffer is a vector, so a task sends one row a key.

    Null vectors are left out; the vectors of one key have one length.
    """
    return assignments.where(F.col(vector).isNotNull()).groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias("centroid"))


def confidence(assignments: DataFrame, means: DataFrame, *keys: str, vector: str = "embedding") -> DataFrame:
    """Cosine of each point and its topic's mean."""
    return assignments.join(means, list(keys)).withColumn("confidence", cosine(F.col(vector), F.col("centroid"))).drop("centroid")


def min_cluster_size(n: Column, least: int = DEFAULTS.min_cluster_points, percent: float = DEFAULTS.min_cluster_percent) -> Column:
    return F.greatest(F.lit(least), F.bround(n * percent / 100.0).cast("int"))


def _dealt(rows: DataFrame, keys: list[str], block: int | None, *more: str) -> DataFrame:
    """``rows`` (the keys, id, v and more) once for every pair of blocks of its group that its own block belongs to.

    ``block`` fixes the vectors of a block. Only groups of more than one block are counted in the join, so it is short.
    Of several forms each gets fewer blocks: as many as make no task more than its share of all pairs.
    """
    n = F.count(F.lit(1))
    counted = rows.groupBy(*keys).agg(n.alias("__n"), F.max(F.size("v")).alias("__width"))
    size, share = F.col("__n"), F.lit(BLOCKS)
    if block is None and len(keys) == 1:
        counted = counted.crossJoin(F.broadcast(rows.groupBy(*keys).agg(n.cast("double").alias("n")).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("__all"))))
        share = F.ceil(size * BLOCKS / F.col("__all") - 1e-9)
    few = F.greatest(F.least(F.ceil(size / BLOCK), share), F.ceil(size * F.col("__width") / NUMBERS)) if block is None else F.ceil(size / block)
    sizes = counted.select(*keys, few.cast("int").alias("__blocks")).where("__blocks > 1")
    own = rows.join(sizes, keys, "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    own = own.withColumn("__block", F.pmod(F.xxhash64("id"), F.col("__blocks").cast("long")).cast("int"))
    met = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    pair = met.select(*keys, F.least("__block", "__other").alias("i"), F.greatest("__block", "__other").alias("j"), "__block", "id", "v", *more)
    return pair.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "id")


def tiles(rows: int, columns: int) -> Iterator[slice]:
    """Slices of the rows whose products with all columns are at most ``TILE`` numbers."""
    step = max(1, TILE // max(columns, 1))
    return (slice(lo, lo + step) for lo in range(0, rows, step))


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Key (the first columns) and rows of each group of sorted batches."""
    key, parts = None, []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        new = np.zeros(len(batch), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            here = tuple(c[lo].item() for c in columns)
            if here != key and parts:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = here
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield key, pa.Table.from_batches(parts)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of length one (zeros stay); shorter ones end in zeros."""
    lists = column.combine_chunks()
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(lists.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        m = flat.reshape(-1, width)
    else:
        m = np.zeros((len(sizes), width))
        m[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def pairs_within(rows: DataFrame, keys: list[str], limit: str, block: int | None = None) -> DataFrame:
    """Pairs ``keys, a, b, similarity`` (a < b) of each group whose cosine reaches the group's ``limit``.

    ``rows`` has the keys (whole numbers), ``id``, ``v`` and ``limit``, one value for a group. Pairs of blocks
    are multiplied once each, so a group of any size is spread over tasks.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in groups(batches, n + 2):
            i, j = key[n:]
            left = table["__block"].to_numpy() == i
            right = left if i == j else ~left
            ids, m, least = table["id"].to_numpy(), matrix(table["v"]), table[limit][0].as_py()
            own, other, own_ids, other_ids = m[left], m[right], ids[left], ids[right]
            for tile in tiles(len(own), len(other)):
                sims = own[tile] @ other.T
                x, y = np.nonzero(sims >= least - 1e-12)
                a, b, s = own_ids[tile][x], other_ids[y], sims[x, y]
                keep = a < b if i == j else a != b
                out = [pa.array([k] * int(keep.sum()), pa.int64()) for k in key[:n]]
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep]), pa.array(s[keep])], [*keys, "a", "b", "similarity"])

    return _dealt(rows, keys, block, limit).mapInArrow(run, ", ".join([*(f"{k} long" for k in keys), "a long", "b long", "similarity double"]))


def single(m: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vectors in single precision, and more than what a cosine of two of them can be off by."""
    return m.astype(np.float32), 1.2e-7 * (m.shape[1] + 8)


def reaching(a: np.ndarray, b: np.ndarray, a32: np.ndarray, b32: np.ndarray, least: float, off: float) -> np.ndarray:
    """Which cosines of unit vectors reach ``least``: made in single precision, and again in double where that leaves it open."""
    sims = a32 @ b32.T
    near = sims >= np.float32(least - off)
    x, y = np.nonzero(near & (sims <= np.float32(least + off)))
    for lo in range(0, len(x), TILE // 64):
        some = slice(lo, lo + TILE // 64)
        near[x[some], y[some]] = np.einsum("ij,ij->i", a[x[some]], b[y[some]]) >= least
    return near


def near_counts(rows: DataFrame, asked: str | None = None) -> DataFrame:
    """``form_id, id, n``: how many others of its form are within the form's ``limit`` of a row (``form_id, id, v, limit``); those with any.

    A task adds up its pairs of a block, so no pair is written. ``asked`` names a column that tells whose numbers are wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (f, i, j), table in groups(batches, 3):
            left = table["__block"].to_numpy() == i
            ids, m, least = table["id"].to_numpy(), matrix(table["v"]), table["limit"][0].as_py() - 1e-12
            m32, off = single(m)
            wanted = table[asked].to_numpy() if asked else np.ones(len(ids), bool)
            n = np.zeros(len(ids), np.int64)
            for a, b in [(left, left)] if i == j else [(left, ~left), (~left, left)]:
                own, to = np.flatnonzero(a & wanted), np.flatnonzero(b)
                other, other32 = m[to], m32[to]
                for tile in tiles(len(own), len(to)):
                    near = reaching(m[own[tile]], other, m32[own[tile]], other32, least, off)
                    if i == j:
                        near[ids[own[tile]][:, None] == ids[to][None, :]] = False
                    n[own[tile]] += near.sum(1)
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array([f] * int(some.sum()), pa.int64()), pa.array(ids[some]), pa.array(n[some])], ["form_id", "id", "n"])

    parts = _dealt(rows, ["form_id"], None, "limit", *([asked] if asked else [])).mapInArrow(run, "form_id long, id long, n long")
    return parts.groupBy("form_id", "id").agg(F.sum("n").alias("n"))


def _probed(rows: DataFrame, *more: str) -> DataFrame:
    """``rows`` in groups ``form_id, block`` of about ``PROBED`` rows, each with the same ``PROBES`` or so of the form's rows (``probe``)."""
    sizes = rows.groupBy("form_id").agg(F.count(F.lit(1)).alias("__n"))
    own = rows.join(sizes, "form_id").withColumn("__blocks", F.ceil(F.col("__n") / PROBED).cast("int"))
    every = own.select("form_id", F.pmod(F.xxhash64("id"), F.col("__blocks").cast("long")).cast("int").alias("block"), F.lit(False).alias("probe"), "id", "v", *more)
    probes = own.where(F.pmod(F.xxhash64("id", F.lit(DEFAULTS.seed)), F.ceil(F.col("__n") / PROBES)) == 0)
    copies = probes.select("form_id", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("block"), F.lit(True).alias("probe"), "id", "v", *more)
    return every.unionByName(copies).repartition("form_id", "block").sortWithinPartitions("form_id", "block")


def core_points(rows: DataFrame, min_pts: int) -> DataFrame:
    """``form_id, id`` of the rows (as for :func:`near_counts`) with at least ``min_pts`` others within the form's limit; staged.

    Those with so many among the form's probes are known at once; only the others are compared with all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (f, _), table in groups(batches, 2):
            probe, ids, m, least = table["probe"].to_numpy(), table["id"].to_numpy(), matrix(table["v"]), table["limit"][0].as_py() - 1e-12
            m32, off = single(m)
            own, to, enough = np.flatnonzero(~probe), np.flatnonzero(probe), np.zeros(len(ids), bool)
            for tile in tiles(len(own), len(to)):
                near = reaching(m[own[tile]], m[to], m32[own[tile]], m32[to], least, off)
                near[ids[own[tile]][:, None] == ids[to][None, :]] = False
                enough[own[tile]] = near.sum(1) >= min_pts
            yield pa.RecordBatch.from_arrays([pa.array([f] * int(enough.sum()), pa.int64()), pa.array(ids[enough])], ["form_id", "id"])

    sure = stage(_probed(rows, "limit").mapInArrow(run, "form_id long, id long"), "sure-cores")
    open_ = stage(rows.select("form_id", "id").join(sure, ["form_id", "id"], "left_anti"), "open-points")
    if open_.isEmpty():
        return sure
    flagged = rows.join(open_.withColumn("__open", F.lit(True)), ["form_id", "id"], "left").withColumn("__open", F.coalesce("__open", F.lit(False)))
    more = near_counts(flagged.join(open_.select("form_id").distinct(), "form_id", "left_semi"), "__open").where(F.col("n") >= min_pts)
    return stage(sure.unionByName(more.select("form_id", "id")), "cores")


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (the smallest place of each component) once the places x and y are linked."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _joined_by(label: np.ndarray, own: np.ndarray, to: np.ndarray, m: np.ndarray, m32: np.ndarray, least: float, off: float) -> np.ndarray:
    """Labels once the places ``own`` and ``to`` are linked where their cosine reaches ``least``."""
    other, other32 = m[to], m32[to]
    for tile in tiles(len(own), len(to)):
        near = reaching(m[own[tile]], other, m32[own[tile]], other32, least, off)
        x, y = np.nonzero(near & (label[own[tile]][:, None] != label[to][None, :]))
        label = _joined(label, own[tile][x], to[y])
    return label


def _first_parts(cores: DataFrame) -> DataFrame:
    """``id, part`` of core points that are linked with others by way of their form's probes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in groups(batches, 2):
            probe, ids, m, least = table["probe"].to_numpy(), table["id"].to_numpy(), matrix(table["v"]), table["limit"][0].as_py() - 1e-12
            m32, off = single(m)
            same = np.unique(ids, return_index=True, return_inverse=True)
            label = _joined(np.arange(len(ids)), np.arange(len(ids)), same[1][same[2].reshape(-1)])  # a probe and itself
            label = _joined_by(label, np.flatnonzero(~probe), np.flatnonzero(probe), m, m32, least, off)
            moved = np.flatnonzero(ids != ids[label])
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["a", "b"])

    return connected_components(_probed(cores, "limit").mapInArrow(run, "a long, b long")).withColumnRenamed("component", "part")


def near_links(rows: DataFrame) -> DataFrame:
    """``form_id, id, other, similarity`` from rows ``form_id, id, v, limit, core``: what the pairs within the limit say about components.

    Without a similarity, two core points of one component: of all pairs of a pair of blocks a task sends as few as connect the same
    points. With one (rounded), a point that is not core and its nearest core point in a block; ties by id. Core points are linked by way of
    their form's probes first; the largest part that this gives needs no look at itself.
    """
    parts = _first_parts(rows.where("core").select("form_id", "id", "v", "limit"))
    placed = rows.join(parts, "id", "left").withColumn("part", F.when(F.col("core"), F.coalesce("part", "id")))
    placed = stage(placed.select(*rows.columns, "part"), "parts")
    first = placed.where("part != id").select("form_id", "id", F.col("part").alias("other"), F.lit(None).cast("double").alias("similarity"))
    sums = placed.where("core").groupBy("form_id", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("form_id").agg(F.max(F.struct("n", "part"))["part"].alias("__main"))
    flagged = placed.join(sums, "form_id").withColumn("main", F.coalesce(F.col("part") == F.col("__main"), F.lit(False)))  # forms without a core point have no links
    left = flagged.where("not main").select("form_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (f, i, j), table in groups(batches, 3):
            left = table["__block"].to_numpy() == i
            ids, m, core, main, least = table["id"].to_numpy(), matrix(table["v"]), table["core"].to_numpy(), table["main"].to_numpy(), table["limit"][0].as_py() - 1e-12
            part = np.where(core, table["part"].fill_null(-1).to_numpy(), -1)
            m32, off = single(m)
            sides = [left, left] if i == j else [left, ~left]
            known = np.unique(part[core], return_index=True, return_inverse=True)
            label = np.arange(len(ids))
            label[core] = np.flatnonzero(core)[known[1]][known[2].reshape(-1)]  # a part is a component from the start
            start = label.copy()
            label = _joined_by(label, np.flatnonzero(sides[0] & core & ~main), np.flatnonzero(sides[1] & core), m, m32, least, off)
            if i != j:
                label = _joined_by(label, np.flatnonzero(sides[1] & core & ~main), np.flatnonzero(sides[0] & core & main), m, m32, least, off)
            moved = np.flatnonzero((label != start) & (start == np.arange(len(ids))))
            found = [(ids[moved], ids[label[moved]], np.full(len(moved), np.nan))]
            for a, b in [sides] if i == j else [sides, sides[::-1]]:
                outer, inner = np.flatnonzero(a & ~core), np.flatnonzero(b & core)  # in the order of ids
                to = m[inner]
                for tile in tiles(len(outer), len(inner)):
                    if len(inner):
                        sims = m[outer[tile]] @ to.T
                        rounded = np.where(sims >= least, np.round(sims, 9), -9.0)
                        best = rounded.argmax(1)
                        s = rounded[np.arange(len(best)), best]
                        found.append((ids[outer[tile]][s > -9], ids[inner][best][s > -9], s[s > -9]))
            id_, to_, s = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(s), pa.int64()), pa.array(id_), pa.array(to_), pa.array(s, mask=np.isnan(s))], ["form_id", "id", "other", "similarity"])

    more = _dealt(flagged.join(left, "form_id", "left_semi"), ["form_id"], None, "limit", "core", "part", "main").mapInArrow(run, "form_id long, id long, other long, similarity double")
    return first.unionByName(more)


def plain_rows(vectors: DataFrame, form: str, id_col: str, vector: str) -> DataFrame:
    """``form_id, id, v`` of the rows that have a vector."""
    return vectors.where(F.col(vector).isNotNull()).select(F.col(form).cast("long").alias("form_id"), F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))


def radius_join(vectors: DataFrame, threshold: float = DEFAULTS.near_duplicate, form: str = "form_id", id_col: str = "id", vector: str = "embedding", block: int | None = None, limits: DataFrame | None = None) -> DataFrame:
    """Pairs ``form_id, a, b, similarity`` (a < b) of one form with cosine at least ``threshold``.

    ``limits`` (``form_id, limit``) gives forms thresholds of their own; forms that it does not name have no pairs.
    Null vectors have no pairs, and zero vectors none above 0. Exact: every pair of blocks is multiplied once.
    """
    rows = plain_rows(vectors, form, id_col, vector)
    rows = rows.withColumn("limit", F.lit(float(threshold))) if limits is None else rows.join(limits.select("form_id", F.col("limit").cast("double").alias("limit")), "form_id")
    return pairs_within(rows, ["form_id"], "limit", block)


def nearest(sims: np.ndarray, own: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, neighbour and distance of the ``k`` nearest of ``others`` to each row; ties by id, itself left out.

    The k-th greatest of the greatest cosines of some shares of a row is a bound: only what reaches it is sorted.
    """
    sims = np.where(own[:, None] == others[None, :], -np.inf, sims)
    shares = max(8 * k, 64)
    bound = np.full(len(own), -9.0)
    if len(others) >= 4 * shares:
        most = sims[:, : len(others) // shares * shares].reshape(len(own), shares, -1).max(2)
        bound = np.partition(most, shares - k, axis=1)[:, shares - k] - 4e-9  # distances that are alike to nine places
    x, y = np.nonzero(sims >= np.maximum(bound, -9.0)[:, None])
    d = np.sqrt(np.maximum(2 - 2 * sims[x, y], 0))
    order = np.lexsort((others[y], np.round(d, 9), x))
    x, y, d = x[order], y[order], d[order]
    kept = np.arange(len(x)) - np.searchsorted(x, x) < k
    return own[x[kept]], others[y[kept]], d[kept]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two sets of unit vectors; those of near ones are not rounded off, so that copies are at distance 0."""
    sims = np.einsum("ij,ij->i", a, b)
    return np.where(sims > 0.99, np.linalg.norm(a - b, axis=1), np.sqrt(np.maximum(2 - 2 * sims, 0)))


def closest(own: np.ndarray, others: np.ndarray, own_ids: np.ndarray, other_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What :func:`nearest` gives for the cosines of two sets of unit vectors, for some rows after others.

    Cosines are made in single precision; what may be among the ``k`` greatest of a row by then is made again in double.
    """
    own32, off = single(own)
    others32, none = others.astype(np.float32), np.empty(0, np.int64)
    by_id = np.argsort(other_ids, kind="stable")
    for top in range(0, len(own), HIGH):
        rows, ids = own[top : top + HIGH], own_ids[top : top + HIGH]
        great = np.full((len(rows), k), -9.0, np.float32)  # the k greatest so far, smallest first
        x, y = none, none
        first, last = (np.searchsorted(other_ids[by_id], ids, side) for side in ("left", "right"))
        itself = np.repeat(np.arange(len(ids)), last - first)
        there = by_id[np.arange(len(itself)) - np.repeat(np.cumsum(last - first) - last, last - first)]

        def cut(x: np.ndarray, y: np.ndarray, rows: np.ndarray = rows, ids: np.ndarray = ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The k nearest of each row among places x, y."""
            d = np.concatenate([_distances(rows[x[s]], others[y[s]]) for s in tiles(len(x), 64)] or [np.empty(0)])
            order = np.lexsort((other_ids[y], np.round(d, 9), x))
            x, y, d = x[order], y[order], d[order]
            kept = np.arange(len(x)) - np.searchsorted(x, x) < k
            return x[kept], y[kept], d[kept]

        for lo in range(0, len(others), WIDE):
            sims = own32[top : top + HIGH] @ others32[lo : lo + WIDE].T
            here = (there >= lo) & (there < lo + WIDE)
            sims[itself[here], there[here] - lo] = -np.inf
            hit = np.flatnonzero(sims.max(1) >= great[:, 0] - np.float32(2 * off))
            if lo == 0:
                shares = sims[:, : sims.shape[1] // max(8 * k, 64) * max(8 * k, 64)]
                if shares.shape[1] >= 4 * max(8 * k, 64):
                    great = np.sort(np.partition(shares.reshape(len(rows), max(8 * k, 64), -1).max(2), -k, axis=1)[:, -k:], axis=1)
            bound = great[hit, 0] - np.float32(2 * off + 4e-9)
            hx, hy = np.nonzero(sims[hit] >= np.maximum(bound, np.float32(-8))[:, None])
            if lo > 0 or great[0, 0] == -9:  # the first share's greatest are in already
                values = sims[hit[hx], hy]
                order = np.lexsort((-values, hx))
                place = np.arange(len(hx)) - np.searchsorted(hx[order], hx[order])
                few = order[place < k]
                new = np.full((len(hit), k), -9.0, np.float32)
                new[hx[few], place[place < k]] = values[few]
                great[hit] = np.sort(np.concatenate([great[hit], new], axis=1), axis=1)[:, -k:]
            x, y = np.concatenate([x, hit[hx]]), np.concatenate([y, lo + hy])
            if len(x) > TILE:
                x, y, _ = cut(x, y)
        x, y, d = cut(x, y)
        yield ids[x], other_ids[y], d


def first_neighbours(near: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each row of ``form_id, id, neighbour, distance``, with their ``place``; ties by id."""
    place = F.row_number().over(Window.partitionBy("form_id", "id").orderBy(F.round("distance", 9), "neighbour"))
    return near.withColumn("place", place).where(F.col("place") <= k)


def knn_join(vectors: DataFrame, k: int = DEFAULTS.knn, form: str = "form_id", id_col: str = "id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """``form_id, id, neighbour, distance, place``: the k nearest others by euclidean distance of the
    unit vectors; ties by id. Each block keeps k candidates of a row before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (f, i, j), table in groups(batches, 3):
            left = table["__block"].to_numpy() == i
            ids, m = table["id"].to_numpy(), matrix(table["v"])
            for own, other in [(left, left)] if i == j else [(left, ~left), (~left, left)]:
                for columns in closest(m[own], m[other], ids[own], ids[other], k):
                    yield pa.RecordBatch.from_arrays([pa.array([f] * len(columns[0]), pa.int64()), *map(pa.array, columns)], ["form_id", "id", "neighbour", "distance"])

    near = _dealt(plain_rows(vectors, form, id_col, vector), ["form_id"], block).mapInArrow(run, "form_id long, id long, neighbour long, distance double")
    return first_neighbours(near, k)


def reassign_outliers(assignments: DataFrame, threshold: float = DEFAULTS.outlier_similarity, form: str = "form_id", topic: str = "topic_key", vector: str = "embedding", id_col: str = "id") -> DataFrame:
    """``assignments`` whose outliers (null topic) join the topic with the nearest mean, if it is near enough.

    Means come from clustered points only and are made once; ties go to the smallest topic key. A
    form has few topics, so its outliers meet the form's means by an equi-join on the form.
    """
    means = centroids(assignments.where(F.col(topic).isNotNull()), form, topic, vector=vector).withColumn("centroid", unit(F.col("centroid").cast("array<float>")))
    out = assignments.where(F.col(topic).isNull())
    sims = out.select(form, id_col, unit(F.col(vector)).alias("__v")).join(means.withColumnRenamed(topic, "__topic"), form).select(form, id_col, "__topic", F.round(dot(F.col("__v"), F.col("centroid")), 9).alias("__sim"))
    best = sims.where(F.col("__sim") >= threshold).groupBy(form, id_col).agg(F.min(F.struct((-F.col("__sim")).alias("s"), F.col("__topic").alias("t"))).alias("b")).select(form, id_col, F.col("b.t").alias("__new"))
    return assignments.join(best, [form, id_col], "left").withColumn(topic, F.coalesce(topic, "__new")).withColumn("rescued", F.col("__new").isNotNull()).drop("__new")
