"""Quality classifier: a linear support vector machine on naive Bayes features.

Features are indicators of word 1- and 2-grams and of 1- to 3-grams over word shapes (letter case,
symbols, whether a word repeats the one before), hashed to ``DIM`` places. Class counts of the
features cover all labelled training rows; the hinge-loss model is fitted on at most
``MAX_FIT_ROWS`` of them by dual coordinate descent (Hsieh et al. 2008), scaled by the log-count
ratios (Wang and Manning 2012), and its margins are turned into probabilities on rows set aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, bounded_batches, row_keys, stage, without_ids
from .words import mix, slices, words

DIM_BITS = 18
#: Labelled rows that the support vector machine is fitted on; their class counts use all.
MAX_FIT_ROWS = 20_000
THRESHOLD = 0.3
SMOOTH, COST = 1.0, 1.0
#: The fit ends at this projected gradient; passes over the rows at most, as a guard.
TOLERANCE, MAX_EPOCHS = 0.05, 1000

#: Class of each byte: 0 other, 1 small letter, 2 capital, 3 digit, 4 symbol, 5 end of a sentence.
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[x for x in range(33, 127) if not chr(x).isalnum()]] = 4
_KIND[[44, 46]] = 5


def _shapes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, new_text: np.ndarray) -> np.ndarray:
    """A small number for the look of each word."""
    kinds = _KIND[data]
    out = np.zeros(len(begin), np.uint64)
    for i, kind in enumerate((1, 2, 4)):
        total = np.concatenate([[0], np.cumsum(kinds == kind)])
        out |= np.minimum(total[end] - total[begin], 3).astype(np.uint64) << np.uint64(2 * i)
    same = np.zeros(len(begin), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same &= ~new_text
    return out | same.astype(np.uint64) << np.uint64(6)


def features(data: np.ndarray, at: np.ndarray, bits: int = DIM_BITS) -> list[np.ndarray]:
    """The sorted distinct feature numbers of each text."""
    h, begin, end, counts = words(data, at, lower=True)
    ends = np.cumsum(counts)
    if not len(h):
        return [np.zeros(0, np.int32) for _ in counts]
    new_text = np.zeros(len(h), bool)
    new_text[(ends - counts)[counts > 0]] = True
    shape = mix(_shapes(data, begin, end, h, new_text) + np.uint64(977))
    place = np.arange(len(h)) - np.repeat(ends - counts, counts)
    columns = []
    for x, n, salt in ((h, 1, 1), (h, 2, 2), (shape, 1, 3), (shape, 2, 4), (shape, 3, 5)):
        acc = x * np.uint64(2 * salt + 1)
        for j in range(1, n):
            acc[j:] += x[:-j] * np.uint64((0x9E3779B97F4A7C15 >> (j + salt)) | 1)
        columns.append(np.where(place >= n - 1, mix(acc) >> np.uint64(64 - bits), np.uint64(1 << bits)).astype(np.int32))
    table = np.stack(columns, 1)
    out, a = [], 0
    for b in ends.tolist():
        x = np.sort(table[a:b], axis=None)
        x = x[: np.searchsorted(x, 1 << bits)]
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
        a = b
    return out


@dataclass
class Model:
    """Weights of the hashed features, and the line that turns a margin into log-odds."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.array([self.weights[x].sum() / np.sqrt(len(x)) if len(x) else 0.0 for x in rows]) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * z + self.shift, -60, 60)))


def dual_descent(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: float = COST, tolerance: float = TOLERANCE, epochs: int = MAX_EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of a hinge-loss model over ratio-scaled indicators of unit row length.

    Each step solves one row's dual variable exactly, within 0 and the row's cost (the costs of the
    rarer class are raised to balance the two). Rows at a bound that want to go beyond it rest until
    the others are done. It ends when no row's projected gradient exceeds ``tolerance``.
    """
    w = np.zeros(len(ratio))
    bias = 0.0
    root = [np.sqrt(max(len(x), 1)) for x in rows]  # values are worked out when needed, to hold one copy of the rows
    upper = cost * np.where(signs > 0, 1.0, max(1.0, (signs > 0).sum() / max(1, (signs < 0).sum())))
    square = ratio * ratio
    norm = np.array([square[x].sum() / (r * r) + 1.0 for x, r in zip(rows, root, strict=True)])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    active, far = np.arange(len(rows)), np.inf
    for _ in range(epochs):
        worst, stay = 0.0, []
        for i in rng.permutation(active).tolist():
            x, y = rows[i], signs[i]
            v = ratio[x] / root[i]
            gap = y * (w[x] @ v + bias) - 1
            if (alpha[i] == 0 and gap > far) or (alpha[i] == upper[i] and gap < -far):
                continue  # rests
            stay.append(i)
            wanted = min(gap, 0.0) if alpha[i] == 0 else max(gap, 0.0) if alpha[i] == upper[i] else gap
            worst = max(worst, abs(wanted))
            if wanted:
                new = min(max(alpha[i] - gap / norm[i], 0.0), upper[i])
                step, alpha[i] = (new - alpha[i]) * y, new
                w[x] += step * v
                bias += step
        if worst <= tolerance:
            if len(active) == len(rows):
                break
            active, far = np.arange(len(rows)), np.inf  # a last look at all rows
        else:
            active, far = np.array(stay, np.int64), worst
    return w, bias


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve with the largest likelihood, by Newton steps."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t, a, b = np.where(y > 0, hi, lo), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        m = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        d = np.linalg.solve(m, [(g * z).sum(), g.sum()])
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-9:
            break
    return float(a), float(b)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", key_col: str = "doc_id", max_rows: int = MAX_FIT_ROWS, bits: int = DIM_BITS) -> Model:
    """A model from rows with a 0/1 label. Without rows of both classes every text scores 0.5.

    ``key_col`` only orders the rows by hash where the sample is drawn; it is no feature.
    """
    rows = bounded_batches(labelled).where(F.col(label_col).isin(0, 1)).select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(key_col), F.lit("fit")).alias("key"))
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, size + 1), np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for i, _, data, at in slices(batch.column(0)):
                for j, x in enumerate(features(data, at, bits)):
                    seen[label[i + j], x] += 1
                    seen[label[i + j], size] += 1
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["place", "n0", "n1"])

    totals = rows.mapInArrow(count, "place long, n0 long, n1 long").groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = totals.toArrow()  # at most 2^bits + 1 rows
    n = np.zeros((2, size + 1))
    n[:, counted["place"].to_numpy()] = [counted["n0"].to_numpy(), counted["n1"].to_numpy()]
    known = n[:, size].copy()
    if not known.all():
        return Model(np.zeros(size), 0.0, 0.0, 0.0)
    p, q = n[1, :size] + SMOOTH, n[0, :size] + SMOOTH
    ratio = np.log((p / p.sum()) / (q / q.sum()))

    share = min(1.0, max_rows / known.sum())
    cut = min(int(share * 2**63), 2**63 - 1)
    sample = rows.where(F.col("key").bitwiseAND(F.lit(2**63 - 1)) <= cut).orderBy("key").limit(max_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for batch in batches:
            ys.append(batch.column(1).to_numpy(zero_copy_only=False))
            for _, _, data, at in slices(batch.column(0)):
                xs += features(data, at, bits)
        y = np.concatenate([*ys, np.zeros(0, np.int32)]).astype(float)
        apart = np.arange(len(y)) % 5 == 0
        here = [x for x, a in zip(xs, apart, strict=True) if not a]
        signs = np.where(y[~apart] > 0, 1.0, -1.0)
        w, bias = dual_descent(here, signs, ratio)
        w *= ratio
        z = np.array([w[x].sum() / np.sqrt(max(len(x), 1)) for x, a in zip(xs, apart, strict=True) if a]) + bias
        slope, shift = _platt(z, y[apart]) if len(z) else (1.0, 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([bias]), pa.array([slope]), pa.array([shift])], ["w", "bias", "slope", "shift"])

    made = sample.coalesce(1).mapInArrow(learn, "w binary, bias double, slope double, shift double").collect()[0]
    return Model(np.frombuffer(made.w, np.float32).astype(np.float64), made.bias, made.slope, made.shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row; null and empty texts get the score of a text without features."""
    bits = len(model.weights).bit_length() - 1
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2^bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.score(features(data, at, bits)) for _, _, data, at in slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*parts, np.zeros(0)]))], ["doc_id", "score"])

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label is kept from learning: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, judged one by one by their texts; rows with a null id stay."""
    rows, key = row_keys(docs, id_col)
    scores = quality_scores(rows, labels, id_col, text_col, row_col=key, **options)
    return without_ids(rows, scores.where("predicted = 0").withColumnRenamed("doc_id", key), key).select(*docs.columns)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, max_rows: int = MAX_FIT_ROWS, row_col: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; with ``row_col``, that column's value stands for the id.

    Labels, language, source and id are no features. Rows with several labels count once each;
    null ids, labels or texts take no part in learning (a null text is scored like an empty one).
    """
    learn = stage(labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("label")).where(~held_out("__id")), "labels")
    if learn.count() <= BROADCAST_IDS:  # texts then stay where they are
        learn = F.broadcast(learn)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text")).where("text is not null")
    labelled = texts.join(learn, "__id").select(F.col("__id").alias("doc_id"), "text", "label")
    model = fit(labelled, max_rows=max_rows)
    return score(docs, model, row_col or id_col, text_col).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
