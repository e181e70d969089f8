"""Operators against plain Python on small tables."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedback_points import schema
from feedback_points.operators import clustering, identity, labels, queue, report, scoring, vectors, words
from feedback_points.operators.components import connected_components
from feedback_points.plans import jobs
from feedback_points.sources import io
from feedback_points.streaming import ingest


def components_of(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (5, 6), (7, 7)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.component for r in connected_components(df).collect()} == components_of(edges)


def unit_rows(n, dims, seed):
    v = np.random.default_rng(seed).normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    centres = unit_rows(3, 8, 5)
    v = np.concatenate([c + rng.normal(scale=0.05, size=(15, 8)) for c in centres] + [unit_rows(6, 8, 9)])
    rows = [(i % 2 if i >= 45 else 0, i, [float(x) for x in v[i]]) for i in range(len(v))]
    return v / np.linalg.norm(v, axis=1, keepdims=True), rows, spark.createDataFrame(rows, "form_id long, id long, embedding array<float>").cache()


def test_radius_and_knn(cloud):
    v, rows, df = cloud
    form = {r[1]: r[0] for r in rows}
    sims = v @ v.T
    want = {(a, b) for a in form for b in form if a < b and form[a] == form[b] and sims[a, b] >= 0.8}
    assert {(r.a, r.b) for r in vectors.radius_join(df, 0.8, block=7).collect()} == want
    near = {}
    for r in vectors.knn_join(df, 3, block=7).collect():
        near.setdefault(r.id, {})[r.place] = r.neighbour
    for i in form:
        order = sorted((j for j in form if j != i and form[j] == form[i]), key=lambda j: (round(float(np.sqrt(max(2 - 2 * sims[i, j], 0))), 6), j))[:3]
        assert [near[i][p + 1] for p in range(len(order))] == order


def test_density_cluster(cloud):
    v, rows, df = cloud
    eps, pts, size = 0.05, 4, 5
    got = {r.id: r.label for r in clustering.density_cluster(df, size, pts, eps).collect()}
    form = {r[1]: r[0] for r in rows}
    sims = v @ v.T
    near = {i: [j for j in form if j != i and form[j] == form[i] and 1 - sims[i, j] <= eps] for i in form}
    core = {i for i in form if len(near[i]) >= pts}
    group = components_of([(i, j) for i in core for j in near[i] if j in core] + [(i, i) for i in core])
    for i in form:
        options = [j for j in near[i] if j in core]
        if i not in core and options:
            group[i] = group[min(options, key=lambda j: (-round(sims[i, j], 9), j))]
    members = {}
    for i, g in group.items():
        members.setdefault((form[i], g), []).append(i)
    want = {i: -1 for i in form}
    for f in set(form.values()):
        big = sorted((min(m), m) for (k, _), m in members.items() if k == f and len(m) >= size)
        for n, (_, m) in enumerate(big):
            want.update(dict.fromkeys(m, n))
    assert got == want and max(got.values()) >= 2


def test_split_large_and_stats(cloud):
    _, _, df = cloud
    base = df.withColumn("topic_key", F.when(F.col("id") < 45, "0"))
    got = {r.id: r.topic_key for r in clustering.split_large_topics(base, 5, 4, 0.05).collect()}
    assert {got[0], got[20], got[40]} == {"0.0", "0.1", "0.2"} and got[50] is None
    stats = report.cluster_size_stats(clustering.topic_keys(clustering.density_cluster(df.where("form_id = 0"), 5, 4, 0.05)), ["form_id"]).first()
    assert stats.topics == 3 and stats.n == 48
    sizes = df.sparkSession.createDataFrame([(100,), (1000,), (3,), (5,)], "n int").select(clustering.sweep_sizes(F.col("n"))).collect()
    assert [r[0] for r in sizes] == [[2, 3, 4, 5, 6, 8, 10], [10, 20, 30, 40, 50, 60, 80, 100], [], []]


def test_parameter_sweep(cloud):
    """Three groups of one form with a word each; rates and words against counts of the clusters themselves."""
    _, _, df = cloud
    points = df.where("form_id = 0").withColumn("point_text", F.concat(F.lit("shared "), F.element_at(F.array(*map(F.lit, ("alpha", "beta", "gamma", "delta"))), (F.col("id") / 20).cast("int") + 1)))
    got = {r.min_size: r for r in clustering.parameter_sweep(points, [4, 6], 4, 0.05).collect()}
    for m, row in got.items():
        own = clustering.density_cluster(points, m, 4, 0.05).toPandas()
        assert row.n == len(own) and row.topics == own.label.max() + 1
        assert row.outlier_before == pytest.approx((own.label < 0).mean(), abs=1e-6) and row.outlier_rate <= row.outlier_before
        assert -1 <= row.npmi <= 1 and 0 < row.diversity <= 1
    assert sorted(got) == [4, 6]
    none = clustering.parameter_sweep(points, [40], 4, 0.05).collect()
    assert [(r.topics, r.outlier_before, r.outlier_rate, r.npmi) for r in none] == [(0, 1.0, 1.0, None)]


def test_vectors(spark):
    df = spark.createDataFrame([(0, 1, "a", [1.0, 0.0]), (0, 2, "a", [0.0, 1.0]), (0, 3, "b", [-1.0, 0.0]), (0, 4, None, [0.6, 0.8]), (0, 5, None, [0.0, -1.0]), (0, 6, None, [0.0, 0.0])], "form_id long, id long, topic_key string, embedding array<float>")
    got = {r.id: r.topic_key for r in vectors.reassign_outliers(df).collect()}
    assert got[4] == "a" and got[5] is None and got[6] is None
    means = vectors.centroids(df.where("topic_key is not null"), "form_id", "topic_key")
    sure = {r.id: r.confidence for r in vectors.confidence(df.where("topic_key is not null"), means, "form_id", "topic_key").collect()}
    assert sure[1] == pytest.approx(np.sqrt(0.5)) and sure[3] == pytest.approx(1)
    sizes = spark.createDataFrame([(8,), (9,), (850,), (1109,)], "n int").select(vectors.min_cluster_size(F.col("n"))).collect()
    assert [r[0] for r in sizes] == [8, 8, 8, 11]
    assert df.where("id = 1").select(vectors.fit_dims(F.col("embedding"), 4)).first()[0] == [1, 0, 0, 0]
    with pytest.raises(Exception, match="wider"):
        df.select(vectors.fit_dims(F.col("embedding"), 1)).collect()


def test_merge_near_duplicates(spark):
    rows = [(0, 1, [1.0, 0.0], "a", 0.9), (0, 2, [0.95, 0.31], "b", 0.5), (0, 3, [0.8, 0.6], None, None), (0, 4, [0.0, -1.0], None, None), (0, 5, [0.05, -1.0], None, None), (0, 6, [-1.0, 0.0], "b", 0.2)]
    df = spark.createDataFrame(rows, "form_id long, id long, embedding array<float>, topic_key string, confidence double")
    got = {r.id: (r.topic_key, r.confidence, r.moved) for r in clustering.merge_near_duplicates(df, 0.9).collect()}
    assert got == {1: ("a", 0.9, False), 2: ("a", 0.5, True), 3: ("a", 0.0, True), 4: (None, None, False), 5: (None, None, False), 6: ("b", 0.2, False)}
    assert {r.topic_key for r in clustering.touched_topics(clustering.merge_near_duplicates(df, 0.9), df).collect()} == {"a", "b"}


def test_identity_partitions_old_topics(spark):
    rng = np.random.default_rng(1)
    rows = [(0, i, f"g{rng.integers(6)}" if rng.random() < 0.9 else None, int(rng.integers(8))) for i in range(300)]
    df = spark.createDataFrame(rows, "form_id long, id long, topic_key string, old_topic_id long")
    topics = spark.createDataFrame([(0, i) for i in range(10)], "form_id long, id long")
    who = identity.resolve_identity(df.drop("old_topic_id"), df.select("id", "old_topic_id"), topics, carry_min=0.2)
    ids = lambda d: {r.old_topic_id for r in d.collect()}
    carried, merged, gone = ids(who.carried), ids(who.merged), ids(who.dissolved)
    assert carried | merged | gone == set(range(10)) and not carried & merged and not carried & gone and not merged & gone
    fresh = identity.resolve_identity(df.drop("old_topic_id"), df.select("id", "old_topic_id").where("false"), topics.where("false"))
    assert fresh.carried.isEmpty() and fresh.new.count() == 6


def test_queue_rules(spark):
    answers = spark.createDataFrame([(1, 1, 1, None, None), (2, 1, 1, "  ", None), (3, 1, 1, "\n", None), (4, 1, 1, "x", datetime(2024, 1, 1)), (5, 1, 2, "x", None), (6, 1, 3, "x", None), (7, 1, 1, "x", None), (8, 1, 1, "y", None)], "id long, submission_id long, field_id long, answer_text string, decomposed_at timestamp")
    fields = spark.createDataFrame([(1, 1, True, None), (2, 1, True, datetime(2024, 1, 1)), (3, 1, False, None)], "id long, form_id long, analyze_with_ai boolean, deleted_at timestamp")
    assert [r.id for r in queue.pending_answers(answers, fields).orderBy("id").collect()] == [7, 8]
    assert [r.id for r in queue.pending_answers(answers, fields, 1).collect()] == [7]
    assert queue.all_decomposed(answers, answers.where("id = 4")) and not queue.all_decomposed(answers, answers.where("id = 7")) and queue.all_decomposed(answers, answers.where("false"))


def test_superseded_ties_survive(spark):
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    points = spark.createDataFrame([(1, 1, t[0]), (2, 1, t[2]), (3, 1, t[2]), (4, 2, t[1])], "id long, answer_id long, created_at timestamp")
    assert [r.id for r in report.superseded_points(points).collect()] == [1]
    assert sorted(r.id for r in report.newest_points(points).collect()) == [2, 3, 4]


def test_spread_examples_half_even(spark):
    rows = [(i, 1, f"t{i}", 1 - i / 100) for i in range(25)]
    got = report.spread_examples(spark.createDataFrame(rows, "id long, topic_id long, point_text string, assignment_confidence double"), 12)
    assert sorted(r.id for r in got.collect()) == sorted({round(i * 24 / 11) for i in range(12)})


def test_labels(spark):
    review = lambda rows: spark.createDataFrame(rows, "your_label string, proposed_label string, text string, stratum string")
    existing = spark.createDataFrame([("none", "Known ")], "expected string, text string")
    good = review([("  ", "Legal", "new", "s"), (" MORAL ", "none", "new", "s"), ("", "none", "known", "s")])
    assert sorted((r.expected, r.text) for r in labels.merge_labels(existing, good).collect()) == [("legal", "new"), ("moral", "new"), ("none", "Known ")]
    with pytest.raises(Exception, match="unknown label"):
        labels.merge_labels(existing, review([("odd", "none", "x", "s")])).collect()
    q = spark.createDataFrame([(i, i) for i in range(6)], "id long, position long")
    with pytest.raises(ValueError):
        labels.insert_repeats(q, 7)
    out = [r.id for r in labels.insert_repeats(q, 2, 2).orderBy("queue_position").collect()]
    assert len(out) == 8 and all(out.index(x) > out.index(x[:-2]) for x in out if x.endswith("#r"))
    folds = labels.stratified_folds(spark.createDataFrame([(i, "a" if i < 23 else "b") for i in range(40)], "id long, s string"), "s").groupBy("s", "fold").count().collect()
    for s in "ab":
        sizes = [r["count"] for r in folds if r.s == s]
        assert max(sizes) - min(sizes) <= 1
    none = labels.agreement(spark.createDataFrame([("1", "0", 1)], "id string, label string, position long"), spark.createDataFrame([(1, 0.1)], "id long, score double")).first()
    assert none.recall is None and none.tn == 1


def test_scores(spark):
    rows = [0.0799, 0.08, 0.4994, 0.4996, 0.5, 0.0]
    df = spark.createDataFrame([(i, {"violence": s}) for i, s in enumerate(rows)], "id long, s map<string,double>")
    got = df.withColumn("b", scoring.best_violation(F.col("s"), {"violence": "legal"})).select("id", "b.category", scoring.violation_status(F.col("b.score"), F.col("b.flagged")).alias("st")).orderBy("id").collect()
    assert [(r.category, r.st) for r in got] == [("none", "none"), ("legal", "possible"), ("legal", "possible"), ("legal", "violation"), ("legal", "violation"), ("none", "none")]
    calls = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, ""), (4, None)], "id long, point_text string")
    made = {r.id: r.embedding for r in scoring.embed(calls, scoring.hashing_encoder(4)).collect()}
    assert made[1] == made[2] and made[3] == [0, 0, 0, 0] and made[4] is None


def test_words(spark):
    docs = spark.createDataFrame([(1, "x", "alpha beta"), (2, "x", "alpha beta gamma"), (3, "y", "delta")], "id long, t string, text string")
    listed = spark.createDataFrame([("x", "alpha", 1), ("x", "beta", 2), ("x", "delta", 3), ("y", "delta", 1), ("y", "absent word", 2)], "t string, term string, place int")
    got = {r.t: r.npmi for r in words.npmi_by_topic(listed, docs, "t").collect()}
    assert got == {"x": pytest.approx((1 - 1 - 1) / 3)}
    assert words.topic_diversity(listed).first()[0] == pytest.approx(4 / 5)
    top = [r.term for r in words.top_words(docs.where("t = 'x'"), 2, "t").orderBy("place").collect()]
    assert top == ["alpha", "alpha beta"]


def test_vocabulary(spark):
    ok = (1, "assigned", "positive", "none", 5)
    rows = [ok, (2, "assigned", None, None, None), (3, "odd", None, None, None), (4, "pending", "positive", None, None), (5, None, "glad", "none", None)]
    df = spark.createDataFrame(rows, "id long, processing_status string, sentiment_label string, violation_status string, canonical_topic_id long")
    assert sorted((r.id, r.fault) for r in schema.vocabulary_faults(df).collect()) == [(2, "assigned_topic"), (3, "processing_status"), (4, "labels_together"), (5, "sentiment_label")]


def test_io(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('feedback_id,raw_text\n1,"two\nlines, ""quoted"""\n2,"  "\n3, x \n')
    rows = io.read_feedback_csv(spark, str(path))
    assert [r.raw_text for r in rows.orderBy("feedback_id").collect()] == ['two\nlines, "quoted"', "x"]
    wave = spark.createDataFrame([(i, "t" * (6000 if i == 3 else 5)) for i in range(20)], "feedback_id long, raw_text string")
    parts = io.load_wave(wave, "feedback_id", 7, 2, 5, "2024-01-01", "2024-01-31")
    assert parts["answers"].count() == 5 and parts["option_answers"].count() == 20
    assert parts["answers"].agg(F.max(F.length("answer_text"))).first()[0] == 5000
    hours = [r[0] for r in parts["submissions"].select(F.hour("created_at")).collect()]
    assert all(8 <= h <= 19 for h in hours)
    made = spark.createDataFrame([("v1", 1, "x", ["a", "b"], "ok")], "variant string, feedback_id long, raw_text string, points array<string>, status string")
    io.write_decomposed(made, str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d")).first()
    assert (back.points_json, back.n_points, back.variant) == ('["a","b"]', 2, "v1")
    io.backup_rows(made, str(tmp_path / "b"))
    with pytest.raises(Exception):
        io.backup_rows(made, str(tmp_path / "b"))
    io.write_points_export(made.drop("points").withColumn("answer_text", F.lit("secret")), str(tmp_path / "e"))
    assert "answer_text" not in spark.read.csv(str(tmp_path / "e"), header=True).columns


def test_upsert_topics(spark):
    old = spark.createDataFrame([(1, 1, "a", "s", datetime(2024, 1, 1), datetime(2024, 1, 1)), (2, 1, "b", "t", datetime(2024, 1, 1), datetime(2024, 1, 1))], "id long, form_id long, canonical_name string, canonical_summary string, created_at timestamp, updated_at timestamp")
    new = spark.createDataFrame([(1, 1, "a2", None), (3, 1, "c", "u")], "id long, form_id long, canonical_name string, canonical_summary string")
    got = {r.id: (r.canonical_name, r.canonical_summary, r.created_at.year, r.updated_at.year) for r in io.upsert_topics(old, new, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert got == {1: ("a2", "s", 2024, 2025), 2: ("b", "t", 2024, 2024), 3: ("c", "u", 2025, 2025)}


def test_write_by_form_keeps_other_forms(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_by_form(spark.createDataFrame([(1, 1), (2, 2)], "id long, form_id long"), path)
    io.write_by_form(spark.createDataFrame([(9, 2)], "id long, form_id long"), path)
    assert sorted((r.id, r.form_id) for r in spark.read.parquet(path).collect()) == [(1, 1), (9, 2)]


ANSWERS = "id long, submission_id long, field_id long, answer_text string, created_at timestamp, decomposed_at timestamp"


def test_ingest_stream_twice(spark, tmp_path):
    source, points, marks = (str(tmp_path / x) for x in ("in", "points", "marks"))
    rows = [(i, 1, 1, f"a{i}, b" if i % 2 else "short one", datetime(2024, 1, 1, i), None) for i in range(6)]
    spark.createDataFrame(rows + rows[:2], ANSWERS).write.parquet(source)

    def split(batch):
        return batch.select(F.col("id").alias("answer_id"), F.posexplode(F.split("answer_text", ", ")).alias("point_no", "point_text"), F.lit("ok").alias("status"))

    def run(checkpoint):
        ingest.ingest_stream(ingest.answer_stream(spark, source, ANSWERS), split, points, marks, str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r.answer_id, r.point_no) for r in spark.read.parquet(points).collect())

    first = run("c1")
    assert len(first) == 9 and run("c1") == first
    spark.createDataFrame([(9, 1, 1, "z", datetime(2024, 1, 1, 9), None), rows[3]], ANSWERS).write.mode("append").parquet(source)
    assert run("c1") == sorted(first + [(9, 0)])


def test_ingest_stream_reads_answers_of_any_date(spark, tmp_path):
    """One file a trigger, dates out of order, repeats within a file and across files: each answer once."""
    source, points, marks = (str(tmp_path / x) for x in ("in", "points", "marks"))
    days = [10, 11, 1, 12]
    for n, day in enumerate(days):
        rows = [(n, 1, 1, f"answer {n}", datetime(2024, 1, day), None)] * 2 + [(0, 1, 1, "answer 0", datetime(2024, 1, 10), None)]
        spark.createDataFrame(rows, ANSWERS).coalesce(1).write.mode("append").parquet(source)
    split = lambda batch: batch.select(F.col("id").alias("answer_id"), F.lit(0).alias("point_no"), F.col("answer_text").alias("point_text"), F.lit("ok").alias("status"))
    ingest.ingest_stream(ingest.answer_stream(spark, source, ANSWERS, 1), split, points, marks, str(tmp_path / "c")).awaitTermination()
    assert sorted(r.answer_id for r in spark.read.parquet(points).collect()) == [0, 1, 2, 3]


def test_event_time_streams(spark, tmp_path):
    path, out = str(tmp_path / "p"), str(tmp_path / "o")
    rows = [(1, 5, datetime(2024, 1, 1, 0, 0)), (1, 5, datetime(2024, 1, 1, 0, 10)), (2, 6, datetime(2024, 1, 1, 0, 0)), (1, 5, datetime(2024, 1, 5))]
    kind = "form_id long, canonical_topic_id long, created_at timestamp"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], kind).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)

    def run(df, name):
        q = df.writeStream.format("parquet").option("checkpointLocation", f"{out}/c-{name}").option("path", f"{out}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{out}/{name}").collect()

    bursts = run(ingest.quiet_forms_stream(stream()), "quiet")
    assert {(r.form_id, r.points) for r in bursts} == {(1, 2), (2, 1)}
    trend = run(ingest.trend_stream(stream()), "trend")
    assert {(r.topic_id, r.points) for r in trend} == {(5, 2), (6, 1)}
    waited = run(ingest.waiting_too_long_stream(stream()), "waited")
    assert {1, 2} >= {r.form_id for r in waited}


def test_recluster_job(spark, cloud):
    _, _, df = cloud
    base = df.select("form_id", "id", F.lit(1).cast("long").alias("answer_id"), F.concat(F.lit("word"), F.floor(F.col("id") / 15).cast("string")).alias("point_text"), "embedding", F.lit("neutral").alias("sentiment_label"), F.lit(False).alias("is_violation"), F.when(F.col("id") < 15, 7).cast("long").alias("canonical_topic_id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    topics = spark.createDataFrame([(7, 0, "old")], "id long, form_id long, canonical_name string")
    done = jobs.recluster(base, topics, 5, eps=0.05)
    rows = {r.id: r for r in done.assignments.collect()}
    assert len(rows) == 51 and {rows[i].canonical_topic_id for i in range(15)} == {7}
    assert all((r.processing_status == "assigned") == (r.canonical_topic_id is not None) for r in rows.values())
    assert done.topics.count() == 3 and {r.topic_key for r in done.identity.new.collect()} == {r.topic_key for r in done.topics.where("topic_id != 7").collect()}
