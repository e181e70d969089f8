"""Indexes, hierarchies, bounded summaries, change files and stateful streams against their plain forms."""

from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedback_points.operators import clustering, components, hierarchy, labels, neighbours, queue, scoring, splitting, vectors, words
from feedback_points.plans import jobs
from feedback_points.session import stage_path
from feedback_points.sources import changes, io
from feedback_points.streaming import ingest, retries


def frame(spark, m, forms=None):
    return spark.createDataFrame([(0 if forms is None else int(forms[i]), i, [float(x) for x in v]) for i, v in enumerate(m)], "form_id long, id long, embedding array<float>")


@pytest.fixture(scope="module")
def clustered():
    """Groups of similar vectors, loose ones, copies and zero vectors, in two forms."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    near = np.repeat(centres, 12, axis=0) + rng.normal(scale=0.28, size=(480, 24))
    m = np.concatenate([near, rng.normal(size=(100, 24)), np.repeat(near[:1], 30, axis=0), np.zeros((3, 24))]).astype(np.float32)
    return m, np.arange(len(m)) % 2


# --- similar pairs and neighbours ---------------------------------------------------------------


def test_similar_pairs(spark, clustered):
    m, forms = clustered
    df = frame(spark, m, forms).cache()
    exact = {(r.a, r.b): r.similarity for r in vectors.radius_join(df, 0.8, block=100).collect()}
    plan = neighbours.Plan(2, 40)
    got = {(r.a, r.b): r.similarity for r in neighbours.similar_pairs(df, 0.8, plan=plan).collect()}
    assert set(got) <= set(exact) and all(abs(exact[p] - s) < 1e-5 for p, s in got.items())
    copies = {i for i in range(580, 610)} | {0}
    alone = [p for p in exact if not set(p) & copies]
    assert sum(p in got for p in alone) >= 0.95 * len(alone)
    # copies hang on their smallest id, so the same points are connected
    for f in (0, 1):
        own = sorted(i for i in copies if forms[i] == f)
        assert {(own[0], i) for i in own[1:]} <= set(got) and not {(a, b) for a in own[1:] for b in own[1:]} & set(got)
    assert neighbours.similar_pairs(df.where("false"), 0.8).count() == 0
    with pytest.raises(ValueError, match="too low"):
        neighbours.plan_tables(10**6, 0.01, 0.99)


def test_index_work_grows_with_rows(spark):
    """On one form of 100,000 vectors: fewer than 200 comparisons a vector, a fixed number of copies, recall at the threshold."""
    rng = np.random.default_rng(0)
    n, d = 100_000, 32
    base = rng.normal(size=(n // 2, d)).astype(np.float32)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turn = rng.normal(size=base.shape).astype(np.float32)
    turn -= (turn * base).sum(1, keepdims=True) * base
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    m = np.concatenate([base, 0.801 * base + np.sqrt(1 - 0.801**2) * turn])  # each half a pair just over the threshold
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(m.reshape(-1)))
    df = spark.createDataFrame(pa.table({"form_id": pa.array(np.zeros(n, np.int64)), "id": pa.array(np.arange(n)), "embedding": lists}))
    plan = neighbours.plan_tables(n, 0.8, 0.96)
    assert plan.tables <= 80
    assert neighbours.candidate_count(df, plan) < 200 * n
    part = df.where(f"pmod(id, {n // 2}) < 5000")
    got = neighbours.similar_pairs(part, 0.8, recall=0.96).where(f"b - a = {n // 2}").count()
    assert got >= 0.95 * 5000


def test_knn_graph(spark, clustered):
    m, forms = clustered
    df = frame(spark, m[:580], forms).cache()
    exact, got = ({}, {})
    for out, rows in ((exact, vectors.knn_join(df, 5)), (got, neighbours.knn_graph(df, 5, chunk=16, tables=2))):
        for r in rows.collect():
            out.setdefault(r.id, {})[r.place] = (r.neighbour, round(r.distance, 5))
    assert all(sorted(x) == [1, 2, 3, 4, 5] for x in got.values()) and len(got) == 580
    hit = sum(len(set(exact[i].values()) & set(got[i].values())) for i in exact)
    assert hit >= 0.95 * 5 * len(exact)


def test_knn_graph_copies(spark, clustered):
    """Copies are each other's neighbours, smallest ids first, as in the exact join; small forms are exact."""
    m, _ = clustered
    few = np.concatenate([m[:8], np.repeat(m[:2], 4, axis=0)])
    df = frame(spark, few)
    want = {(r.id, r.place): r.neighbour for r in vectors.knn_join(df, 3).collect()}
    assert {(r.id, r.place): r.neighbour for r in neighbours.knn_graph(df, 3).collect()} == want
    assert neighbours.knn_graph(frame(spark, np.zeros((3, 4))), 2).count() == 0 == neighbours.knn_graph(df.where("false"), 2).count()


def test_knn_graph_of_unrelated_vectors(spark):
    """Vectors without groups have few neighbours in common: the graph's recall is measured, and weak forms are done again."""
    m = np.random.default_rng(11).normal(size=(1500, 48))
    df = frame(spark, m, np.where(np.arange(1500) < 1200, 0, 1)).cache()
    exact = vectors.knn_join(df, 5).select("form_id", "id", "neighbour")
    hit = exact.join(neighbours.knn_graph(df, 5, width=8), ["form_id", "id", "neighbour"]).groupBy("form_id").count()
    assert {r.form_id: r["count"] >= 0.95 * 5 * n for r, n in zip(hit.orderBy("form_id").collect(), (1200, 300), strict=True)} == {0: True, 1: True}


def test_knn_graph_keeps_a_good_graph(spark, monkeypatch):
    """Groups of near vectors in a large form come from the graph itself."""
    rng = np.random.default_rng(12)
    m = np.repeat(rng.normal(size=(150, 24)), 12, axis=0) + rng.normal(scale=0.28, size=(1800, 24))
    df = frame(spark, m).cache()
    whole = []
    monkeypatch.setattr(neighbours, "knn_join", lambda rows, *a, **b: whole.append(rows.count()) or vectors.knn_join(rows, *a, **b))
    got = neighbours.knn_graph(df, 5).select("form_id", "id", "neighbour").cache()
    assert got.count() == 5 * 1800 and not whole
    assert got.join(vectors.knn_join(df, 5), ["form_id", "id", "neighbour"]).count() >= 0.95 * 5 * 1800


def test_nearest_ties(spark):
    sims = np.array([[1.0, 0.5, 0.5, 0.5, 0.9], [0.5, 1.0, 0.2, 0.5, 0.5]])
    row, other, _ = vectors.nearest(sims, np.array([7, 3]), np.array([7, 3, 1, 2, 9]), 3)
    assert list(zip(row, other, strict=True)) == [(7, 9), (7, 1), (7, 2), (3, 2), (3, 7), (3, 9)]
    assert len(vectors.nearest(sims[:, :2], np.array([7, 3]), np.array([7, 3]), 3)[0]) == 2


def test_density_cluster_writes_no_pairs(spark, monkeypatch):
    """Points that are all near each other: tasks send a few rows a point and block, and blocks do not change labels."""
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.normal(size=16) + rng.normal(scale=0.05, size=(400, 16)), rng.normal(size=(3, 16))[[0] * 60 + [1] * 40] + rng.normal(scale=0.2, size=(100, 16)), rng.normal(size=(100, 16))])
    df = frame(spark, m, np.arange(600) % 2).cache()
    monkeypatch.setattr(clustering, "radius_join", None)
    one = {r.id: r.label for r in clustering.density_cluster(df, 8, eps=0.2).collect()}
    monkeypatch.setattr(vectors, "BLOCK", 32)
    assert {r.id: r.label for r in clustering.density_cluster(df, 8, eps=0.2).collect()} == one
    rows = df.select("form_id", "id", F.col("embedding").alias("v"), F.lit(0.8).alias("limit"))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.8) & (np.arange(600)[:, None] % 2 == np.arange(600) % 2) & ~np.eye(600, dtype=bool)
    assert {r.id: r.n for r in vectors.near_counts(rows).collect()} == {i: n for i, n in enumerate(near.sum(1).tolist()) if n}
    assert near.sum() > 60_000 and vectors.near_links(rows.withColumn("core", F.col("id") % 3 != 0)).count() <= 600 * vectors.BLOCKS


def test_closest_is_nearest(monkeypatch):
    """Single precision and shares of the others leave the k nearest as they are, copies and repeated ids included."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(700, 16))
    m[300:400], m[650:] = m[:1], m[100:150]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = rng.permutation(700)
    ids[10] = ids[20]
    for wide, high, tile in ((2048, 1024, 1 << 21), (600, 64, 4096), (50, 32, 256)):
        for name, value in (("WIDE", wide), ("HIGH", high), ("TILE", tile)):
            monkeypatch.setattr(vectors, name, value)
        for own, others in ((slice(0, 700), slice(0, 700)), (slice(0, 350), slice(200, 700)), (slice(0, 9), slice(5, 8))):
            sims = m[own] @ m[others].T
            want = vectors.nearest(np.where(sims > 1 - 1e-12, 1, sims), ids[own], ids[others], 5)
            got = [np.concatenate(c) for c in zip(*vectors.closest(m[own], m[others], ids[own], ids[others], 5), strict=True)]
            assert all(np.array_equal(x, y) for x, y in zip(want[:2], got[:2], strict=True)) and np.allclose(want[2], got[2], atol=1e-7)


def test_probes_settle_most_points(spark, monkeypatch):
    """Points near enough probes are not compared with all; the labels are those of all pairs."""
    rng = np.random.default_rng(6)
    groups_ = [rng.normal(size=16) + rng.normal(scale=0.1, size=(n, 16)) for n in (300, 300, 60, 5)]
    bridge = [x / np.linalg.norm(x) for x in (groups_[0].mean(0), groups_[1].mean(0))]
    path = [t * bridge[0] + (1 - t) * bridge[1] for t in np.linspace(0, 1, 60)]
    m = np.concatenate([*groups_, np.array(path), rng.normal(size=(40, 16))])
    m = m[rng.permutation(len(m))]
    df = frame(spark, m, np.arange(len(m)) % 2).cache()
    for name, value in (("PROBES", 40), ("PROBED", 100), ("BLOCK", 64)):
        monkeypatch.setattr(vectors, name, value)
    asked = []
    real = vectors.near_counts
    monkeypatch.setattr(vectors, "near_counts", lambda rows, column: asked.append(rows.where(column).count()) or real(rows, column))
    got = {r.id: r.label for r in clustering.density_cluster(df, 8, 4, eps=0.1).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {}
    for form in (0, 1):
        ids = np.flatnonzero(np.arange(len(m)) % 2 == form)
        sims = unit[ids] @ unit[ids].T
        near = (sims >= 0.9 - 1e-12) & ~np.eye(len(ids), dtype=bool)
        core = near.sum(1) >= 4
        label = np.arange(len(ids))
        for _ in range(len(ids)):
            label[core] = [label[near[i] & core].min(initial=label[i]) for i in np.flatnonzero(core)]
        label[~core] = [label[np.where(near[i] & core, sims[i], -1).argmax()] if (near[i] & core).any() else -1 for i in np.flatnonzero(~core)]
        large = [x for x in np.unique(label) if x >= 0 and (label == x).sum() >= 8]
        firsts = sorted(large, key=lambda x: np.flatnonzero(label == x).min())
        want |= {int(i): firsts.index(x) if x in large else -1 for i, x in zip(ids, label, strict=True)}
    assert got == want and len(set(want.values())) > 2
    assert len(asked) == 1 and 0 < asked[0] < 0.5 * len(m)


def test_growth_curve_of_one_topic_compares_no_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = frame(spark, rng.normal(size=8) + rng.normal(scale=0.05, size=(400, 8)))
    compared, real = [], clustering.knn_join
    monkeypatch.setattr(clustering, "knn_join", lambda rows, *a, **b: compared.append(rows.count()) or real(rows, *a, **b))
    got = sorted(tuple(r) for r in clustering.growth_curve(labels.growth_prefixes(df.drop("form_id"), (0.5, 1.0)), 8, eps=0.3).select("fraction", "n", "topics", "purity").collect())
    assert got == [(0.5, 200, 1, 1.0), (1.0, 400, 1, 1.0)] and sum(compared) == 0


def test_rows_are_sent_to_few_blocks(spark):
    df = spark.range(20_000).select(F.lit(0).cast("long").alias("form_id"), "id", F.array(F.lit(1.0).cast("float")).alias("v"))
    assert vectors._dealt(df, ["form_id"], None).count() == 20_000 * vectors.BLOCKS


def test_forms_share_their_blocks(spark):
    """The vectors of several forms are sent to fewer blocks each; one large form among small ones keeps its own."""
    rows = lambda form, n: spark.range(n).select(F.lit(form).cast("long").alias("form_id"), (F.col("id") + 100_000 * form).alias("id"), F.array(F.lit(1.0).cast("float")).alias("v"))
    five = rows(0, 20_000).unionByName(rows(1, 20_000)).unionByName(rows(2, 20_000)).unionByName(rows(3, 20_000)).unionByName(rows(4, 20_000))
    assert vectors._dealt(five, ["form_id"], None).count() == 100_000 * vectors.BLOCKS / 2
    assert vectors._dealt(rows(0, 20_000).unionByName(rows(1, 500)), ["form_id"], None).count() == 20_000 * vectors.BLOCKS + 500


def test_rows_with_ids_alone_are_shuffled(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") % 1000 != 7, F.col("id")).alias("id"), F.lit("text").alias("text"))
    ids = spark.range(0, 60_000, 10).select(F.when(F.col("id") % 100 != 0, F.col("id")).alias("id"))
    got = [r.id for r in io.rows_with(rows, ids).collect()]
    want = {i for i in range(0, 50_000, 10) if i % 100}
    assert want <= set(got) and len(got) == len(set(got)) < len(want) + 50
    assert io.rows_with(rows, ids.where("false")).count() == 0


def test_sweep_writes_texts_once(spark, monkeypatch):
    """The words of topics are those of texts that are written again for them."""
    rng = np.random.default_rng(7)
    m = np.concatenate([rng.normal(size=8) + rng.normal(scale=0.05, size=(30, 8)) for _ in range(3)])
    df = frame(spark, m, np.arange(90) % 2).withColumn("point_text", F.concat_ws(" ", F.concat(F.lit("word"), (F.col("id") / 30).cast("int")), F.concat(F.lit("other"), F.col("id") % 4)))
    written, real = [], clustering.stage
    monkeypatch.setattr(clustering, "stage", lambda x, name: written.append(name) or real(x, name))
    run = lambda: sorted(tuple(r) for r in clustering.parameter_sweep(df, [4, 6], 4, 0.05).collect())
    few = run()
    assert "sweep-texts" not in written and all(r[3] == 3 for r in few)
    monkeypatch.setattr(clustering, "PLACES", 0)
    assert run() == few and "sweep-texts" in written


def test_index_that_compares_more_than_all_pairs_is_not_used(spark, monkeypatch):
    m = np.random.default_rng(5).normal(size=(300, 32))
    df = frame(spark, np.concatenate([m, m[:5]])).cache()
    monkeypatch.setattr(neighbours, "hashed", None)
    got = {(r.a, r.b) for r in neighbours.similar_pairs(df, 0.35, recall=0.9995).collect()}
    exact = {(r.a, r.b) for r in vectors.radius_join(frame(spark, m), 0.35).collect()}
    assert got == exact | {(i, 300 + i) for i in range(5)} and exact


def test_merge_by_index(spark, clustered):
    m, forms = clustered
    df = frame(spark, m, forms).withColumn("topic_key", F.when(F.col("id") % 3 == 0, (F.col("id") % 7).cast("string"))).withColumn("confidence", F.col("id") / 1000.0)
    keys = lambda d: {r.id: r.topic_key for r in d.collect()}
    exact, got = keys(clustering.merge_near_duplicates(df, 0.9)), keys(clustering.merge_near_duplicates(df, 0.9, index=True))
    assert sorted(got) == sorted(exact) and sum(got[i] == exact[i] for i in exact) >= 0.98 * len(exact)


# --- hierarchy ----------------------------------------------------------------------------------


def brute_forest(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    out = []
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b, w))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_spanning_forest(spark, seed):
    rng = np.random.default_rng(seed)
    n = 60
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (150, 2)) if a != b})
    weighted = [(a, b, float(rng.integers(0, 6 if seed == 2 else 1000))) for a, b in edges]
    df = spark.createDataFrame([(0, *e) for e in weighted], "form_id long, a long, b long, weight double")
    assert sorted((r.a, r.b, r.weight) for r in hierarchy.spanning_forest(df).collect()) == sorted(brute_forest(weighted))


def test_forest_of_nothing_and_of_a_chain(spark):
    kind = "form_id long, a long, b long, weight double"
    assert hierarchy.spanning_forest(spark.createDataFrame([], kind)).count() == 0
    chain = spark.createDataFrame([(0, i, i + 1, float(i)) for i in range(200)] + [(0, 5, 5, 0.0)], kind)
    assert hierarchy.spanning_forest(chain).count() == 200


def test_sweep_equals_density_labels(spark, clustered):
    """Every size from one forest has the labels of a clustering of its own, also at limits of the forms' own."""
    m, forms = clustered
    df = frame(spark, m[:580], forms).cache()
    sizes = [3, 8, 13]
    tried = df.select("form_id").distinct().select("form_id", F.explode(F.array(*map(F.lit, sizes))).alias("min_size"))
    for eps in (0.25, None):
        got = clustering.sweep_keys(df, tried, 4, eps)
        found = {(r.min_size, r.id): r.topic_key for r in got.collect()}
        for s in sizes:
            want = {r.id: None if r.label < 0 else str(r.label) for r in clustering.density_cluster(df, s, 4, eps).collect()}
            assert {i: found[s, i] for i in want} == want
        assert len(found) == 3 * 580


def test_pairs_of_a_form_do_not_depend_on_others(spark):
    """A sparse form beside a dense one: its wide limit makes no pairs there."""
    rng = np.random.default_rng(7)
    dense = np.concatenate([c + rng.normal(scale=0.02, size=(40, 12)) for c in rng.normal(size=(5, 12))])
    sparse = rng.normal(size=(30, 12))
    both = frame(spark, np.concatenate([dense, sparse]), np.repeat([0, 1], [200, 30]))
    count = lambda df: {r.form_id: r["count"] for r in clustering.pair_graph(df, 4)[0].groupBy("form_id").count().collect()}
    assert count(both)[0] == count(both.where("form_id = 0"))[0] and count(both)[1] == count(both.where("form_id = 1"))[1]


# --- words --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(11)
    rows = [(i, ["x", "y", None][i % 3], " ".join(f"w{z}" for z in np.minimum(rng.zipf(1.3, 60), 900)) if i % 17 else None) for i in range(300)]
    return spark.createDataFrame(rows, "id long, t string, text string").repartition(5).cache()


@pytest.mark.parametrize(("keep", "capacity"), [(2000, 10**6), (20, 10**6), (20, 300), (1, 60)])
def test_top_words_are_exact(texts, keep, capacity):
    plain = {}
    for r in words.term_counts(texts, "t", stop=["w1"]).collect():
        plain.setdefault(r.t, []).append((-r.n, r.term))
    want = {t: [(term, -n) for n, term in sorted(own)[:7]] for t, own in plain.items()}
    got = {}
    for r in words.top_words(texts, 7, "t", stop=["w1"], keep=keep, capacity=capacity).orderBy("place").collect():
        got.setdefault(r.t, []).append((r.term, r.n))
    assert got == want
    whole = [r.term for r in words.top_words(texts, 3, stop=[], keep=keep, capacity=capacity).orderBy("place").collect()]
    counts = Counter()
    for r in words.term_counts(texts, stop=[]).collect():
        counts[r.term] = r.n
    assert whole == sorted(counts, key=lambda x: (-counts[x], x))[:3]


@pytest.mark.parametrize(("keep", "capacity"), [(2000, 10**6), (30, 400)])
def test_class_tfidf_is_exact(texts, keep, capacity):
    counts = {(r.t, r.term): r.n for r in words.term_counts(texts, "t", stop=[]).collect()}
    topics = {t for t, _ in counts}
    size = {t: sum(n for (u, _), n in counts.items() if u == t) for t in topics}
    total = Counter()
    for (_, term), n in counts.items():
        total[term] += n
    average = sum(size.values()) / len(size)
    weight = {(t, term): np.sqrt(n / size[t]) * np.log1p(average / total[term]) for (t, term), n in counts.items()}
    got = {}
    for r in words.class_tfidf(texts, "t", 6, stop=[], keep=keep, capacity=capacity).orderBy("place").collect():
        got.setdefault(r.t, []).append(r.term)
        assert r.weight == pytest.approx(weight[r.t, r.term])
    assert got == {t: [term for _, term in sorted((-round(w, 9), term) for (u, term), w in weight.items() if u == t)[:6]] for t in topics}
    assert words.class_tfidf(texts.where("false"), "t").count() == 0 == words.top_words(texts.where("false"), 3, "t").count()


def test_counters_stay_within_capacity(spark, monkeypatch):
    """Terms of one frequency settle nothing: they are counted by a shuffle, not in ever larger counters."""
    df = spark.createDataFrame([(f"w{i % 40:02d} x{i % 37:02d}",) for i in range(400)], "text string")
    asked, made = [], words._tallies
    monkeypatch.setattr(words, "_tallies", lambda *a: asked.append(a[-1]) or made(*a))
    got = [(r.term, r.n) for r in words.top_words(df, 3, stop=[], keep=2, capacity=8).orderBy("place").collect()]
    assert got == [(f"x0{i}", 11) for i in range(3)] and asked == [8]


def test_npmi_asks_for_pairs_of_a_topic_only(spark):
    """A thousand topics of ten words: the pairs that are counted are those of topics, whatever documents hold."""
    listed = spark.createDataFrame([(f"t{t}", f"word{chr(97 + t % 26)}{chr(97 + t // 26 % 26)}{chr(97 + t // 676)}{chr(97 + k)}", k) for t in range(1000) for k in range(10)], "t string, term string, place int")
    own = [r.term for r in listed.where("t in ('t1', 't2', 't3')").collect()]
    docs = spark.createDataFrame([(i, " ".join(own if i % 2 else own[:10])) for i in range(40)], "id long, text string")
    got = {r.t: r.npmi for r in words.npmi_by_topic(listed, docs, "t", k=10).collect()}
    assert set(got) == {"t1", "t2", "t3"}
    first = [t for t in ("t1", "t2", "t3") if set(r.term for r in listed.where(f"t = '{t}'").collect()) == set(own[:10])]
    assert got[first[0]] == 1.0


# --- change files -------------------------------------------------------------------------------


def test_changes_equal_full_updates(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 4, i, "p", [float(i)] if i % 3 else None, ["positive", None][i % 2], "none", "none", "pending", None, None) for i in range(400)]
    kind = "form_id long, id long, point_text string, embedding array<float>, sentiment_label string, violation_status string, violation_type string, processing_status string, canonical_topic_id long, assignment_confidence double"
    points = spark.createDataFrame(rows, kind)
    path = stage_path(spark, "changes")
    changes.create(points, path)
    plain, update = points, {"features": io.update_point_features, "labels": io.update_point_labels, "assignment": io.assign_points}
    for n, what in enumerate(["features", "labels", "assignment", "features", "labels"], 1):
        ids = sorted(rng.choice(400, 90, replace=False).tolist())
        if what == "assignment":
            new = spark.createDataFrame([(i % 4, i, "assigned", i % 5, None) for i in ids], "form_id long, id long, processing_status string, canonical_topic_id long, assignment_confidence double")
        else:
            new = spark.createDataFrame([(i % 4, i, [None, "negative"][i % 2], [None, "violation"][i // 2 % 2]) for i in ids], "form_id long, id long, sentiment_label string, violation_status string")
        changes.write_change(new, path, what, n)
        changes.write_change(new, path, what, n)  # repeated: replaces itself
        full = new if what != "labels" else new.withColumn("violation_type", F.lit(None).cast("string"))
        plain = update[what](plain, full if what == "assignment" else new)
        if n == 3:
            assert changes.fold_in(spark, path, 0.3)
            assert changes.fold_in(spark, path, 0.3) == []
        key = lambda df: sorted((tuple(r) for r in df.select(*points.columns).collect()), key=lambda r: r[1])
        assert key(changes.read(spark, path)) == key(plain)
    with pytest.raises(ValueError):
        changes.write_change(points.select("form_id", "id", "point_text"), path, "labels", 9)


def test_change_writes_what_changes(spark, tmp_path):
    points = spark.range(20_000).select((F.col("id") % 2).alias("form_id"), "id", F.md5(F.col("id").cast("string")).alias("point_text"), F.lit("positive").alias("sentiment_label"), F.array((F.rand(1) * 9).cast("float"), F.rand(2).cast("float"), F.rand(3).cast("float")).alias("embedding"))
    path = str(tmp_path / "t")
    changes.create(points, path)
    changes.write_change(points.where("id % 100 = 0").select("form_id", "id", F.lit("negative").alias("sentiment_label")), path, "labels", 1)
    size = lambda folder: sum(p.stat().st_size for p in (tmp_path / "t" / folder).rglob("*.parquet"))
    assert size("changes") < 0.05 * size("base")
    assert changes.read(spark, path).where("sentiment_label = 'negative'").count() == 200


def test_read_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    try:
        spark.range(100).select("id", (F.col("id") * 2).alias("twice")).write.jdbc(url, "numbers", properties={"driver": driver})
    except Exception as e:
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            pytest.skip("no database driver here")
        raise
    back = io.read_jdbc(spark, url, "numbers", 0, 100, 4, column="id", driver=driver)
    assert back.rdd.getNumPartitions() == 4 and back.agg(F.sum("twice")).first()[0] == 9900


# --- streams ------------------------------------------------------------------------------------

ATTEMPTS = "answer_id long, at timestamp, outcome string"
START = datetime(2024, 1, 1)


def replay(spark, folder, batches, checkpoint, out):
    for rows in batches:
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(folder)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    retries.retry_ledger_stream(stream).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in retries.latest(spark.read.parquet(out)).collect())


def test_retry_stream_equals_ledger_and_restarts(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 12)), START + timedelta(minutes=int(m)), ["ok", "failed", "failed", "unreachable"][rng.integers(0, 4)]) for m in rng.permutation(120)]
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    first = replay(spark, folder, [rows[:30], rows[30:70]], checkpoint, out)
    batch = lambda part: sorted(tuple(r) for r in ingest.retry_ledger(spark.createDataFrame(part, ATTEMPTS)).collect())
    assert first == batch(rows[:70])
    assert replay(spark, folder, [], checkpoint, out) == first  # a restart changes nothing
    assert replay(spark, folder, [rows[70:] + [(None, START, "ok"), (3, None, "ok")]], checkpoint, out) == batch(rows)


def test_due_retries(spark, tmp_path):
    kind = "form_id long, at timestamp, outcome string"
    at = lambda s: START + timedelta(seconds=s)
    batches = [[(1, at(0), "failed"), (2, at(0), "failed"), (3, at(0), "failed")], [(2, at(10), "ok"), (3, at(20), "failed")], [(9, at(3600), "ok")], [(9, at(7200), "ok")]]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)
    due = retries.due_retries_stream(stream, late="1 minute")
    due.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.form_id, r.failures) for r in spark.read.schema(due.schema).parquet(out).collect()}
    assert got == {(1, 1), (3, 2)}


def test_ingest_marks_are_not_read_again(spark, tmp_path, monkeypatch):
    """A query looks at no marks of its own; another checkpoint finds all of them."""
    answers = "id long, submission_id long, field_id long, answer_text string, created_at timestamp, decomposed_at timestamp"
    source, points, marks = (str(tmp_path / x) for x in ("in", "points", "marks"))
    seen = []
    real = ingest._marked_before
    monkeypatch.setattr(ingest, "_marked_before", lambda *a: (lambda df: seen.append(df.count()) or df)(real(*a)))
    split = lambda batch: batch.select(F.col("id").alias("answer_id"), F.lit(0).alias("point_no"), F.col("answer_text").alias("point_text"), F.lit("ok").alias("status"))

    def run(checkpoint):
        ingest.ingest_stream(ingest.answer_stream(spark, source, answers, 1), split, points, marks, str(tmp_path / checkpoint)).awaitTermination()
        return sorted(r.answer_id for r in spark.read.parquet(points).collect())

    for b in range(4):
        spark.createDataFrame([(10 * b + i, 1, 1, f"text {i}", START, None) for i in range(10)] + [(0, 1, 1, "text 0", START, None)], answers).coalesce(1).write.mode("append").parquet(source)
    assert run("one") == list(range(40)) and seen == [0, 0, 0, 0]
    assert run("two") == list(range(40)) and seen[4:] == [40, 40, 40, 40]
    spark.createDataFrame([(99, 1, 1, "late", START, None)], answers).write.mode("append").parquet(source)
    assert run("one") == [*range(40), 99]


# --- rows that were weak ------------------------------------------------------------------------


def test_generate_feedback_gives_n(spark):
    shapes = spark.createDataFrame([("bad", 3.0, "{thing} is broken"), ("bad", 3.0, "why is {thing} broken"), ("good", 1.0, "I like {thing}")], "kind string, weight double, text string")
    pool = {"thing": [f"item{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]}
    args = {"violations": ["they stole {thing}"], "joiners": ["{a}. {b}."], "seed": 5}
    held = spark.createDataFrame([(f"I like item{chr(97 + i)}a",) for i in range(20)], "raw_text string")
    rows = splitting.generate_feedback(shapes, pool, 1000, existing=held, **args).collect()
    keys = [" ".join(sorted(r.raw_text.lower().replace(".", "").split())) for r in rows]
    assert len(rows) == 1000 == len(set(keys)) and not set(keys) & {" ".join(sorted(r.raw_text.lower().split())) for r in held.collect()}
    kinds = Counter(r.kind for r in rows)
    assert 20 < kinds["violation"] < 110 and kinds["bad"] > kinds["good"] and 150 < sum(". " in r.raw_text for r in rows) < 500
    assert sorted(map(tuple, splitting.generate_feedback(shapes, pool, 1000, existing=held, **args).collect())) == sorted(map(tuple, rows))
    assert splitting.generate_feedback(shapes, pool, 0).count() == 0
    with pytest.raises(ValueError, match="different rows"):
        splitting.generate_feedback(shapes, {"thing": ["one"]}, 50)


def test_repair_passes(spark):
    told = ["The user wants tea", "The user wants wifi"]
    before = spark.createDataFrame([(i, "I want tea, the user wants wifi", told, "ok") for i in range(5)], "answer_id long, answer_text string, points array<string>, status string")
    half, whole = '["I want tea", "The user wants wifi"]', '["I want tea", "I want wifi"]'
    first = spark.createDataFrame([(0, half), (1, half), (2, '["I like elephants", "and giraffes"]'), (3, whole)], "answer_id long, raw string")
    second = spark.createDataFrame([(0, whole), (1, None), (2, whole), (3, '["x"]')], "answer_id long, raw string")
    got = {r.answer_id: (r.status, list(r.points)) for r in splitting.accept_repair(before, first, second).collect()}
    assert got == {0: ("ok+repaired", ["I want tea", "I want wifi"]), 1: ("ok+repair_error", ["I want tea", "The user wants wifi"]), 2: ("ok+repair_shape", told), 3: ("ok+repaired", ["I want tea", "I want wifi"]), 4: ("ok", told)}


def test_ingest_job_repairs(spark):
    answers = spark.createDataFrame([(1, 1, 1, "I want tea and I also want some more wifi please", None)], "id long, submission_id long, field_id long, answer_text string, decomposed_at timestamp")
    fields = spark.createDataFrame([(1, 1, True, None)], "id long, form_id long, analyze_with_ai boolean, deleted_at timestamp")
    responses = spark.createDataFrame([(1, '["The user wants tea", "I want more wifi"]')], "answer_id long, raw string")
    attempts = spark.createDataFrame([], "answer_id long, failures long")
    fix = spark.createDataFrame([(1, '["I want tea", "I want more wifi"]')], "answer_id long, raw string")
    rows = jobs.ingest(answers, fields, responses, attempts, scoring.word_scorer({}, "neutral"), lambda: lambda texts: [{} for _ in texts], {}, scoring.hashing_encoder(4), repairs=(fix, fix)).collect()
    assert {(r.point_text, r.status) for r in rows} == {("I want tea", "ok+repaired"), ("I want more wifi", "ok+repaired")}


def test_decomposed_lists(spark):
    answers = spark.createDataFrame([(1, START), (2, None), (3, START)], "id long, decomposed_at timestamp")
    lists = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("b", 2), ("c", 9)], "list_id string, id long")
    assert {r.list_id: r.all_decomposed for r in queue.decomposed_lists(answers, lists).collect()} == {"a": True, "b": False, "c": True}


def test_partition_cluster(spark):
    rng = np.random.default_rng(1)
    m = np.concatenate([c + rng.normal(scale=0.01, size=(20, 4)) for c in ([0, 0, 0, 9], [9, 0, 0, 0])])
    got = {r.id: r.label for r in clustering.partition_cluster(frame(spark, m), 2).collect()}
    assert len({got[i] for i in range(20)}) == 1 and {got[i] for i in range(20, 40)} == {1 - got[0]}


# --- rounds of components, texts of several topics ------------------------------------------------


def test_components_of_a_tree_take_few_rounds(spark, monkeypatch):
    """A spanning tree with mixed numbers: labels that go from neighbour to neighbour need as many rounds as its paths are long."""
    rng = np.random.default_rng(5)
    ids = rng.permutation(3000).tolist()
    tree = [(ids[i], ids[max(i - int(rng.integers(1, 4)), i // 1000 * 1000)]) for i in range(3000)]
    tables = []
    real = components.stage
    monkeypatch.setattr(components, "stage", lambda df, name: tables.append(name) or real(df, name))
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(tree, "a long, b long")).collect()}
    want = {}
    for part in (ids[:1000], ids[1000:2000], ids[2000:]):
        want.update(dict.fromkeys(part, min(part)))
    assert got == want and len(tables) <= 40


@pytest.mark.parametrize(("keep", "capacity"), [(2000, 10**6), (30, 400)])
def test_class_tfidf_of_members(texts, keep, capacity):
    """Rows that are in several topics count in each, as if they were repeated."""
    twice = texts.where("t is not null").withColumn("topics", F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit(0).alias("f"), "t"), F.struct(F.lit(1).alias("f"), F.lit("z").alias("t")))).otherwise(F.array(F.struct(F.lit(1).alias("f"), "t"))))
    plain = twice.select("text", F.explode("topics").alias("m")).select("text", "m.f", "m.t")
    rows = lambda df: sorted((r.f, r.t, r.term, r.place, round(r.weight, 9)) for r in df.collect())
    want = rows(words.class_tfidf(plain, "t", 6, stop=["w1"], form="f"))
    assert {(f, t) for f, t, *_ in want} == {(0, "x"), (0, "y"), (1, "x"), (1, "y"), (1, "z")}
    assert rows(words.class_tfidf(twice, "t", 6, stop=["w1"], form="f", members="topics", keep=keep, capacity=capacity)) == want
