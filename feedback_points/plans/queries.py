"""Every operator as a query over the benchmark tables, with its SQL twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clustering, components, identity, labels, neighbours, queue, report, scoring, splitting, vectors, words
from ..session import stage_path
from ..sources import changes, io
from ..streaming import ingest, retries
from . import standins as S
from .standins import with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


OWNED = "JOIN answers a ON p.answer_id = a.id JOIN submissions s ON a.submission_id = s.id"
FLAG = "violation_status IN ('possible', 'violation')"
WORD_SET = "regexp_extract_all(lower(text), '[a-z0-9'']+')"


# --- report -------------------------------------------------------------------------------------


@query(with_("wide", "topics") + f"""
    SELECT t.id AS topic_id, canonical_name, count(p.answer_id) AS feedback_count, count(*) FILTER (WHERE sentiment_label = 'positive') AS positive_count,
      count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral_count, count(*) FILTER (WHERE sentiment_label = 'negative') AS negative_count, count(*) FILTER (WHERE {FLAG}) AS violation_count
    FROM topics t LEFT JOIN wide p ON p.canonical_topic_id = t.id GROUP BY t.id, canonical_name""")
def a1_topic_counts(spark, d):
    return report.topic_counts(S.topics(spark, d), S.wide_points(spark, d))


@query(with_("points") + f"""
    SELECT canonical_topic_id, count(*) AS total_count, count(*) FILTER (WHERE sentiment_label = 'positive') AS positive_count, count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral_count,
      count(*) FILTER (WHERE sentiment_label = 'negative') AS negative_count, count(*) FILTER (WHERE {FLAG}) AS violation_count FROM points WHERE canonical_topic_id IS NOT NULL GROUP BY 1""")
def a2_draft_counts(spark, d):
    p = S.points(spark, d).where("canonical_topic_id is not null").withColumn("is_violation", queue.is_violation(F.col("violation_status")))
    return report.draft_counts(p, "canonical_topic_id")


@query(with_("wide") + "SELECT canonical_topic_id, min(created_at) AS first_seen, max(created_at) AS last_seen FROM wide GROUP BY 1")
def a3_topic_dates(spark, d):
    return report.topic_dates(S.wide_points(spark, d), "canonical_topic_id")


@query(with_("points") + f"""
    , a AS (SELECT answer_id, count(*) AS n FROM points WHERE embedded GROUP BY 1)
    SELECT (SELECT count(*) FROM a) AS answers, count(*) AS points, (SELECT round(avg(n), 6) FROM a) AS mean_points, (SELECT max(n) FROM a) AS max_points,
      count(*) FILTER (WHERE canonical_topic_id IS NULL) AS unclustered, count(*) FILTER (WHERE sentiment_label = 'positive') AS positive_points, count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral_points,
      count(*) FILTER (WHERE sentiment_label = 'negative') AS negative_points, count(*) FILTER (WHERE sentiment_label IS NULL) AS null_points, count(*) FILTER (WHERE {FLAG}) AS flagged,
      1 AS vector_sizes, count(DISTINCT canonical_topic_id) AS topics FROM points WHERE embedded""")
def a4_corpus_summary(spark, d):
    return report.corpus_summary(S.points(spark, d).where("embedding is not null"))


NOW = "2024-02-01 00:00:00"
PENDING = "coalesce(processing_status, 'pending') = 'pending'"
WAITING = "decomposed_at IS NULL AND answer_text IS NOT NULL AND regexp_replace(answer_text, '^\\s+|\\s+$', '', 'g') <> ''"
BACKLOG = f"b AS (SELECT form_id, count(*) AS backlog FROM answers a JOIN submissions s ON a.submission_id = s.id WHERE {WAITING} AND field_id IN (SELECT id FROM fields WHERE analyze_with_ai AND deleted_at IS NULL) GROUP BY 1)"
READY = with_("points", "answers", "submissions", "fields") + f""", {BACKLOG},
    q AS (SELECT form_id, count(*) AS pending_points, (epoch(TIMESTAMP '{NOW}') - floor(epoch(max(p.created_at)))) / 60.0 AS newest, (epoch(TIMESTAMP '{NOW}') - floor(epoch(min(p.created_at)))) / 60.0 AS oldest
          FROM points p {OWNED} WHERE embedded AND {PENDING} GROUP BY 1)
    SELECT coalesce(q.form_id, b.form_id) AS form_id, coalesce(pending_points, 0) AS pending_points, coalesce(backlog, 0) AS backlog, round(newest, 6) AS minutes_since_newest, round(oldest, 6) AS minutes_since_oldest"""


def _ready(spark, d):
    r = queue.readiness(S.points(spark, d), S.answers(spark, d), S.fields(spark, d), S.submissions(spark, d), F.lit(NOW).cast("timestamp"))
    return r.withColumns({c: F.round(c, 6) for c in ("minutes_since_newest", "minutes_since_oldest")})


@query(READY + " FROM q FULL JOIN b ON q.form_id = b.form_id")
def a5_readiness(spark, d):
    return _ready(spark, d)


@query(READY + ", coalesce(pending_points > 0 AND (oldest >= 360 OR (coalesce(backlog, 0) = 0 AND newest >= 30)), false) AS due FROM q FULL JOIN b ON q.form_id = b.form_id")
def st2_due_forms(spark, d):
    return queue.due_forms(_ready(spark, d))


@query(with_("answers", "submissions", "fields") + f", {BACKLOG} SELECT form_id, backlog FROM b")
def a6_ingest_backlog(spark, d):
    return queue.ingest_backlog(S.answers(spark, d), S.submissions(spark, d), S.fields(spark, d))


@query("SELECT o_custkey % 25 AS form_id, max(o_orderdate) AS last_clustered FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def a7_last_clustered(spark, d):
    runs = S.table(spark, d, "orders").where("o_orderstatus = 'F'").select((F.col("o_custkey") % 25).alias("form_id"), F.col("o_orderdate").alias("completed_at"))
    return queue.last_clustered(runs)


@query("SELECT text AS point_text, min(doc_id) AS point_id, min(doc_id % 20) AS form_id, count(*) AS copies FROM documents GROUP BY 1")
def a8_distinct_pool(spark, d):
    return report.distinct_pool(S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("point_text"), (F.col("doc_id") % 20).alias("form_id")))


REACH = with_("wide") + ", r AS (SELECT canonical_topic_id AS topic_id, count(*) AS mentions, count(DISTINCT respondent_id) AS reach FROM wide GROUP BY 1)"


@query(REACH + " SELECT topic_id, mentions, reach, round(mentions / reach, 6) AS inflation, mentions / reach > 1.01 AS inflated FROM r")
def a9_topic_reach(spark, d):
    return report.topic_reach(S.wide_points(spark, d).withColumnRenamed("canonical_topic_id", "topic_id")).withColumn("inflation", F.round("inflation", 6))


@query(REACH + " SELECT count(*) AS topics, CAST(sum(mentions) AS BIGINT) AS mentions, median(reach) AS median_reach, count(*) FILTER (WHERE mentions / reach > 1.01) AS inflated_topics FROM r")
def a9_reach_totals(spark, d):
    return report.reach_totals(report.topic_reach(S.wide_points(spark, d).withColumnRenamed("canonical_topic_id", "topic_id")))


SUPERSEDED = "o AS (SELECT *, max(created_at) OVER (PARTITION BY answer_id) AS newest FROM wide)"


@query(with_("wide", "answers", "submissions") + f", {SUPERSEDED} SELECT form_id, count(*) AS rows, count(DISTINCT answer_id) AS answers FROM o p {OWNED} WHERE p.created_at < newest GROUP BY 1")
def a10_superseded_by_form(spark, d):
    old = report.superseded_points(S.wide_points(spark, d))
    return report.superseded_by_form(queue.point_ownership(old, S.answers(spark, d), S.submissions(spark, d)))


@query(with_("wide") + f", {SUPERSEDED} SELECT answer_id, canonical_topic_id, respondent_id, created_at FROM o WHERE created_at < newest")
def w1_superseded_points(spark, d):
    return report.superseded_points(S.wide_points(spark, d)).select("answer_id", "canonical_topic_id", "respondent_id", "created_at")


@query(with_("wide") + f", {SUPERSEDED} SELECT answer_id, canonical_topic_id, respondent_id, created_at FROM o WHERE created_at >= newest")
def w2_newest_points(spark, d):
    return report.newest_points(S.wide_points(spark, d)).select("answer_id", "canonical_topic_id", "respondent_id", "created_at")


def _gold(spark, d):
    rows = S.table(spark, d, "conversations").select(F.col("conv_id").alias("original_feedback_id"), F.col("turn").alias("sub_point_number"), F.col("text").alias("sub_point_text"))
    return report.points_by_response(rows)


GOLD = "g AS (SELECT conv_id, count(*) AS n, md5(string_agg(trim(text), '|' ORDER BY turn)) AS h FROM conversations WHERE trim(text) <> '' GROUP BY 1)"


@query(f"WITH {GOLD} SELECT conv_id AS original_feedback_id, n AS n_points, h AS points_md5 FROM g")
def a11_points_by_response(spark, d):
    return _gold(spark, d).select("original_feedback_id", F.size("points").cast("long").alias("n_points"), F.md5(F.array_join("points", "|")).alias("points_md5"))


@query(f"WITH {GOLD} SELECT count(*) AS responses, round(avg(n), 6) AS mean_points, count(*) FILTER (WHERE n = 1) AS single, count(*) FILTER (WHERE n > 1) AS multi FROM g")
def a12_gold_stats(spark, d):
    return report.gold_stats(_gold(spark, d))


@query(f"WITH {GOLD} SELECT n AS n_points, count(*) AS responses FROM g GROUP BY 1")
def a12_points_histogram(spark, d):
    return report.points_histogram(_gold(spark, d)).withColumn("n_points", F.col("n_points").cast("long"))


@query(f"""WITH {GOLD}, t AS (SELECT CASE WHEN conv_id % 3 = 0 THEN NULL ELSE conv_id % 2 = 0 END AS label, n > 4 AS m FROM g)
    SELECT coalesce(CAST(label AS VARCHAR), 'NULL') AS label, count(*) FILTER (WHERE m) AS multi, count(*) FILTER (WHERE NOT m) AS single, count(*) FILTER (WHERE label <> m) AS mismatch FROM t GROUP BY 1""")
def a12_label_crosstab(spark, d):
    c = F.col("original_feedback_id")
    g = _gold(spark, d).select(F.when(c % 3 == 0, None).otherwise(c % 2 == 0).alias("has_multiple_points"), (F.size("points") > 4).alias("is_multi"))
    return report.label_crosstab(g)


@query(f"""WITH {GOLD} SELECT coalesce(g.conv_id, b.item_id + 5) AS feedback_id, coalesce(n, 0) AS gold_n, CASE WHEN b.item_id IS NULL THEN 0 ELSE 1 END AS teacher_n,
    d.text IS NULL OR coalesce(n, 0) = 0 AS faulty FROM g FULL JOIN benchmark b ON g.conv_id = b.item_id + 5 LEFT JOIN documents d ON d.doc_id = coalesce(g.conv_id, b.item_id + 5)""")
def j8_gold_with_teacher(spark, d):
    teacher = S.table(spark, d, "benchmark").select((F.col("item_id") + 5).alias("original_feedback_id"), F.array("text").alias("points"))
    source = S.table(spark, d, "documents").select(F.col("doc_id").alias("feedback_id"), F.col("text").alias("raw_text"))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return report.gold_with_teacher(_gold(spark, d), teacher, source).select("feedback_id", n("gold").alias("gold_n"), n("teacher").cast("int").alias("teacher_n"), "faulty")


STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
PRON = "[" + ", ".join(f"'{w}'" for w in X.PRONOUNS) + "]"
SPLIT_SQL = f"""
    w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z0-9'']+') AS rw, regexp_extract_all(lower(left(text, length(text) // 2)), '[a-z0-9'']+') AS pw, length(text) AS len FROM documents WHERE text <> ''),
    s AS (SELECT doc_id, source, pw, list_distinct(list_filter(rw, lambda x: NOT list_contains({STOP}, x) AND length(x) > 2)) AS rc, list_distinct(list_filter(pw, lambda x: NOT list_contains({STOP}, x) AND length(x) > 2)) AS pc,
      list_distinct(list_transform(range(1, len(rw)), lambda i: rw[i] || ' ' || rw[i + 1])) AS rb, list_distinct(list_transform(range(1, len(pw)), lambda i: pw[i] || ' ' || pw[i + 1])) AS pb FROM w),
    m AS (SELECT doc_id, source, CASE WHEN len(rc) > 0 THEN len(list_intersect(pc, rc)) / len(rc) END AS coverage, CASE WHEN len(pb) > 0 THEN len(list_intersect(rb, pb)) / len(pb) END AS fidelity,
      len(list_filter(pw, lambda x: list_contains({PRON}, x))) / greatest(len(pw), 1) AS pronoun_rate FROM s)"""


def _split_scores(spark, d):
    docs = S.table(spark, d, "documents").where("text != ''")
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    return docs.select("doc_id", "source", X.split_scores(F.col("text"), F.array(F.lit("x")), F.array(half)).alias("m"), F.length("text").alias("length")).select("doc_id", "source", "length", "m.*")


@query(f"WITH {SPLIT_SQL} SELECT doc_id, round(coverage, 6) AS coverage, round(fidelity, 6) AS fidelity, round(pronoun_rate, 6) AS pronoun_rate, true AS count_exact FROM m")
def x11_split_scores(spark, d):
    return _split_scores(spark, d).select("doc_id", *[F.round(c, 6).alias(c) for c in ("coverage", "fidelity", "pronoun_rate")], "count_exact")


@query(f"WITH {SPLIT_SQL} SELECT m.source, count(*) AS n, 1.0::DOUBLE AS pred_n, 1.0::DOUBLE AS count_exact, 0.0::DOUBLE AS over_split, 0.0::DOUBLE AS under_split, round(avg(coverage), 3) AS coverage, round(avg(fidelity), 3) AS fidelity, round(avg(pronoun_rate), 3) AS pronoun_rate, round(avg(length(text) / 1000.0), 3) AS latency_s, 0.0::DOUBLE AS parse_error_rate FROM m JOIN documents USING (doc_id) GROUP BY m.source")
def a13_split_quality_summary(spark, d):
    """With the seconds that a request took, here a thousandth of the text's length."""
    return report.split_quality_summary(_split_scores(spark, d).withColumns({"pred_n": F.lit(1), "status": F.lit("ok"), "latency_s": F.col("length") / 1000.0}), ["source"])


@query(with_("points") + f"""SELECT count(*) AS checked, count(*) FILTER (WHERE {FLAG}) AS flagged, round(avg(CAST({FLAG} AS INT)), 6) AS rate, count(*) FILTER (WHERE {FLAG} AND violation_type = 'legal') AS legal_count,
    count(*) FILTER (WHERE {FLAG} AND violation_type = 'ethics') AS ethics_count, count(*) FILTER (WHERE {FLAG} AND violation_type = 'moral') AS moral_count FROM points WHERE violation_status IS NOT NULL""")
def a14_violation_tally(spark, d):
    return report.violation_tally(S.points(spark, d))


@query(with_("wide") + "SELECT canonical_topic_id AS topic_id, CAST(date_trunc('week', created_at) AS TIMESTAMP) AS period, count(*) AS points FROM wide GROUP BY 1, 2")
def a15_topic_trend(spark, d):
    return report.topic_trend(S.wide_points(spark, d))


@query(with_("points", "answers", "submissions") + f""", c AS (SELECT form_id, canonical_topic_id AS t, count(*) AS n FROM points p {OWNED} GROUP BY 1, 2)
    SELECT form_id, CAST(sum(n) AS BIGINT) AS n, count(t) AS topics, round(sum(CASE WHEN t IS NULL THEN n ELSE 0 END) / sum(n), 6) AS outlier_rate, round(max(CASE WHEN t IS NOT NULL THEN n END) / sum(n), 6) AS largest_share,
      median(CASE WHEN t IS NOT NULL THEN n END) AS median_size FROM c GROUP BY 1""")
def a16_cluster_size_stats(spark, d):
    own = queue.point_ownership(S.points(spark, d), S.answers(spark, d), S.submissions(spark, d))
    return report.cluster_size_stats(own, ["form_id"], "canonical_topic_id")


@query(with_("points", "answers", "topics") + f"""SELECT p.id AS point_id, answer_id, point_text, sentiment_label, {FLAG} AS is_violation, canonical_topic_id AS topic_id, canonical_name AS topic_name,
    assignment_confidence, processing_status, 1 AS embedding_dims, p.created_at FROM points p JOIN answers a ON a.id = answer_id LEFT JOIN topics t ON t.id = canonical_topic_id WHERE embedded""")
def j2_points_report(spark, d):
    return report.points_report(S.points(spark, d), S.answers(spark, d), S.topics(spark, d)).drop("answer_text")


@query(with_("topics", "points") + "SELECT id FROM topics t WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.canonical_topic_id = t.id)")
def j4_empty_topics(spark, d):
    return report.empty_topics(S.topics(spark, d), S.points(spark, d)).select("id")


@query(with_("topics", "points") + "SELECT id FROM topics t WHERE EXISTS (SELECT 1 FROM points p WHERE p.canonical_topic_id = t.id)")
def j4_live_topics(spark, d):
    return report.live_topics(S.topics(spark, d), S.points(spark, d)).select("id")


@query("""WITH p AS (SELECT doc_id AS id, doc_id % 200 AS answer_id, text AS t FROM documents),
    n AS (SELECT DISTINCT answer_id FROM p WHERE regexp_matches(t, '\\b(users?|respondents?|the\\s+student|the\\s+writer)\\b|^\\s*request\\s+for\\b', 'i') OR id % 40 = 3)
    SELECT id, answer_id FROM p WHERE answer_id IN (SELECT answer_id FROM n)""")
def j5_points_of_narrated_answers(spark, d):
    p = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 200).alias("answer_id"), F.when(F.col("doc_id") % 40 == 3, F.concat(F.lit("the user says "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("point_text"))
    return queue.points_of_narrated_answers(p).select("id", "answer_id")


@query(with_("points", "topics") + "SELECT p.id, coalesce(canonical_name, 'topic ' || canonical_topic_id, 'unassigned') AS topic_name FROM points p LEFT JOIN topics t ON t.id = canonical_topic_id AND t.id % 3 <> 0")
def j9_topic_label(spark, d):
    named = S.topics(spark, d).where("id % 3 != 0").select(F.col("id").alias("canonical_topic_id"), "canonical_name")
    return S.points(spark, d).join(named, "canonical_topic_id", "left").select("id", report.topic_label(F.col("canonical_topic_id"), F.col("canonical_name")).alias("topic_name"))


@query(with_("points", "answers", "submissions") + f"SELECT p.id, p.answer_id, s.id AS submission_id, form_id FROM points p {OWNED}")
def j1_point_ownership(spark, d):
    return queue.point_ownership(S.points(spark, d), S.answers(spark, d), S.submissions(spark, d)).select("id", "answer_id", "submission_id", "form_id")


@query(with_("points", "answers", "submissions") + f"SELECT p.id FROM points p {OWNED} WHERE form_id IN (1, 3)")
def j3_points_of_forms(spark, d):
    return queue.of_forms(S.points(spark, d), S.answers(spark, d), S.submissions(spark, d), [1, 3]).select("id")


# --- queue --------------------------------------------------------------------------------------


@query(with_("fields") + "SELECT id, form_id FROM fields WHERE analyze_with_ai AND deleted_at IS NULL")
def f1_analysable_fields(spark, d):
    return queue.analysable_fields(S.fields(spark, d))


@query(with_("fields", "forms") + "SELECT id, form_title FROM forms WHERE id IN (SELECT form_id FROM fields WHERE analyze_with_ai AND deleted_at IS NULL)")
def f2_analysable_forms(spark, d):
    return queue.analysable_forms(S.forms(spark, d), S.fields(spark, d))


@query(with_("answers", "fields") + f""", w AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY id) AS r FROM answers WHERE {WAITING} AND field_id IN (SELECT id FROM fields WHERE analyze_with_ai AND deleted_at IS NULL))
    SELECT id, field_id, answer_text FROM w WHERE r <= 20""")
def f3_pending_answers(spark, d):
    return queue.pending_answers(S.answers(spark, d), S.fields(spark, d), 20).select("id", "field_id", "answer_text")


@query(with_("points", "answers", "submissions") + f"SELECT p.id FROM points p {OWNED} WHERE NOT embedded AND form_id IN (0, 2)")
def f4_points_missing_features(spark, d):
    return queue.points_missing_features(S.points(spark, d), S.answers(spark, d), S.submissions(spark, d), [0, 2]).select("id")


@query(with_("points") + "SELECT id FROM points WHERE embedded")
def f5_points_for_relabel(spark, d):
    return queue.points_for_relabel(S.points(spark, d), S.answers(spark, d), S.submissions(spark, d)).select("id")


@query(with_("points", "answers", "submissions") + f"SELECT form_id, p.id, {FLAG} AS is_violation, canonical_topic_id FROM points p {OWNED} WHERE embedded")
def f6_clusterable_points(spark, d):
    return queue.clusterable_points(S.points(spark, d), S.answers(spark, d), S.submissions(spark, d)).select("form_id", "id", "is_violation", "canonical_topic_id")


@query(with_("points", "answers", "submissions") + f"SELECT DISTINCT form_id FROM points p {OWNED} WHERE embedded AND {PENDING}")
def f7_forms_with_unclustered(spark, d):
    return queue.forms_with_unclustered(S.points(spark, d), S.answers(spark, d), S.submissions(spark, d))


@query(with_("pool", "queue") + "SELECT id FROM pool WHERE CAST(id AS VARCHAR) NOT IN (SELECT split_part(id, '#', 1) FROM queue)")
def f9_exclude_taken(spark, d):
    return queue.exclude_taken(S.scored_documents(spark, d), S.labels(spark, d)).select("id")


@query("SELECT doc_id AS feedback_id, CASE WHEN doc_id >= 1000 THEN 'violation' ELSE 'real' END AS source FROM documents WHERE NOT contains(text, 'License') AND NOT contains(text, '!!')")
def f10_drop_excluded_rows(spark, d):
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("feedback_id"), F.col("text").alias("raw_text"))
    return queue.drop_excluded_rows(docs, ["License", "!!"]).select("feedback_id", "source")


# --- windows, sorts, sets -----------------------------------------------------------------------


@query(with_("points") + """, r AS (SELECT *, row_number() OVER (PARTITION BY canonical_topic_id ORDER BY assignment_confidence DESC NULLS LAST, id) AS place FROM points WHERE canonical_topic_id IS NOT NULL)
    SELECT canonical_topic_id AS topic_id, id, CAST(place AS INT) AS place FROM r WHERE place <= 3""")
def w3_top_examples(spark, d):
    p = S.points(spark, d).where("canonical_topic_id is not null").withColumnRenamed("canonical_topic_id", "topic_id")
    return report.top_examples(p).select("topic_id", "id", "place")


@query(with_("points") + """, u AS (SELECT canonical_topic_id AS topic_id, id, assignment_confidence AS c, row_number() OVER (PARTITION BY canonical_topic_id, point_text ORDER BY assignment_confidence DESC NULLS LAST, id) AS copy FROM points WHERE canonical_topic_id IS NOT NULL),
    n AS (SELECT topic_id, id, row_number() OVER (PARTITION BY topic_id ORDER BY c DESC NULLS LAST, id) - 1 AS i, count(*) OVER (PARTITION BY topic_id) AS n FROM u WHERE copy = 1)
    SELECT topic_id, id FROM n WHERE n <= 3 OR i IN (0, round_even((n - 1) / 2, 0), n - 1)""")
def w4_spread_examples(spark, d):
    p = S.points(spark, d).where("canonical_topic_id is not null").withColumnRenamed("canonical_topic_id", "topic_id")
    return report.spread_examples(p, 3).select("topic_id", "id")


FOLDS = "f AS (SELECT doc_id AS id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) - 1) % 5 AS fold FROM documents)"


def _folds(spark, d):
    return labels.stratified_folds(S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "lang")


@query(f"WITH {FOLDS} SELECT id, CAST(fold AS INT) AS fold FROM f")
def w5_stratified_folds(spark, d):
    return _folds(spark, d).select("id", "fold")


@query(f"WITH {FOLDS} SELECT CAST(h AS INT) AS holdout, CASE WHEN fold = h THEN 'eval' ELSE 'train' END AS part, count(*) AS rows FROM f, range(5) AS t(h) GROUP BY 1, 2")
def w9_holdout(spark, d):
    return labels.holdout(_folds(spark, d)).groupBy("holdout", "part").agg(F.count(F.lit(1)).alias("rows"))


BAND = "CASE WHEN category <> 'none' AND score >= 0.75 AND score < 1.01 THEN 'flagged' WHEN category <> 'none' AND score >= 0.5 AND score < 0.75 THEN 'borderline' WHEN category <> 'none' AND score < 0.5 THEN 'weak-violation' WHEN category = 'none' AND score < 0.6 THEN 'uncertain-none' WHEN category = 'none' AND score < 1.01 THEN 'confident-none' END"


@query(with_("pool") + f", b AS (SELECT id, {BAND} AS band FROM pool), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('42|' || id), id) AS r FROM b) SELECT id, band FROM r WHERE r <= CASE band WHEN 'flagged' THEN 36 WHEN 'borderline' THEN 44 WHEN 'weak-violation' THEN 44 WHEN 'uncertain-none' THEN 52 ELSE 24 END")
def w6_band_sample(spark, d):
    return labels.band_sample(S.scored_documents(spark, d)).select("id", "band")


@query("""WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM labels), r AS (SELECT * FROM b ORDER BY md5('42|' || doc_id), CAST(doc_id AS VARCHAR) LIMIT 20),
    u AS (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(place AS DOUBLE) AS k FROM b UNION ALL SELECT doc_id || '#r', least(place + least(100, n // 2), n) - 0.5 FROM r)
    SELECT id, row_number() OVER (ORDER BY k, id) - 1 AS queue_position FROM u""")
def w7_insert_repeats(spark, d):
    q = S.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("position"))
    return labels.insert_repeats(q).select("id", "queue_position")


@query("""WITH o AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
    SELECT f AS fraction, id FROM o, (VALUES (0.15::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) AS t(f) WHERE r < floor(n * f)""")
def w8_growth_prefixes(spark, d):
    return labels.growth_prefixes(S.table(spark, d, "documents").select(F.col("doc_id").alias("id")))


@query(with_("pool") + "SELECT id, score FROM pool ORDER BY md5('42|' || id), id LIMIT 50")
def t2_sample_n(spark, d):
    return labels.sample_n(S.scored_documents(spark, d), 50).select("id", "score")


@query(with_("answers") + "SELECT id FROM answers WHERE decomposed_at IS NULL ORDER BY id LIMIT 100")
def t2_limit_per_pass(spark, d):
    return labels.limit_per_pass(S.answers(spark, d).where("decomposed_at is null"), 100).select("id")


@query(with_("wide", "topics") + "SELECT t.id AS topic_id, count(p.answer_id) AS feedback_count FROM topics t LEFT JOIN wide p ON p.canonical_topic_id = t.id GROUP BY 1")
def t1_rank_topics(spark, d):
    return report.rank_topics(report.topic_counts(S.topics(spark, d), S.wide_points(spark, d))).select("topic_id", "feedback_count")


DECIDED = "d AS (SELECT split_part(id, '#', 1) AS item, CAST(arg_max(label, position) AS INT) AS label FROM queue WHERE label IN ('0', '1') GROUP BY 1), j AS (SELECT item, label, score FROM d JOIN pool ON CAST(pool.id AS VARCHAR) = item)"


@query(with_("queue", "pool") + f""", {DECIDED}, k AS (SELECT *, CASE WHEN label = 0 AND score >= 0.75 THEN 'false_positive' WHEN label = 1 AND score < 0.75 THEN 'false_negative' END AS kind FROM j),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, item) AS place FROM k WHERE kind IS NOT NULL) SELECT item, kind, CAST(place AS INT) AS place, score FROM r WHERE place <= 12""")
def t3_worst_disagreements(spark, d):
    joined = labels.decided(S.labels(spark, d)).join(S.scored_documents(spark, d).select(F.col("id").cast("string").alias("item"), "score"), "item")
    return labels.worst_disagreements(joined).select("item", "kind", "place", "score")


REVIEW = """e AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'none' ELSE 'legal' END AS expected, text FROM benchmark),
    r AS (SELECT CASE WHEN doc_id % 4 = 0 THEN ' Moral ' WHEN doc_id % 4 = 1 THEN ' ' END AS yours, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE 'Ethics' END AS proposed, CASE WHEN doc_id < 10 THEN (SELECT max(text) FROM benchmark WHERE item_id = doc_id) ELSE text END AS text, source FROM documents WHERE text IS NOT NULL)"""
STRIP_SQL = "regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g')"


def _review(spark, d):
    bench = S.table(spark, d, "benchmark")
    existing = bench.select(F.when(F.col("item_id") % 2 == 0, "none").otherwise("legal").alias("expected"), "text")
    first = bench.where("item_id < 10").select(F.col("item_id").alias("doc_id"), F.col("text").alias("known"))
    docs = S.table(spark, d, "documents").where("text is not null").join(first, "doc_id", "left")
    review = docs.select(
        F.when(F.col("doc_id") % 4 == 0, " Moral ").when(F.col("doc_id") % 4 == 1, " ").alias("your_label"), F.when(F.col("doc_id") % 3 == 0, "none").otherwise("Ethics").alias("proposed_label"),
        F.coalesce("known", "text").alias("text"), F.col("source").alias("stratum"),
    )
    return existing, review


CHOSEN = f"coalesce(nullif({STRIP_SQL.format('yours')}, ''), {STRIP_SQL.format('proposed')})"


@query(f"""WITH {REVIEW} SELECT expected, text, 'existing' AS stratum, 'existing' AS source FROM e
    UNION ALL SELECT {CHOSEN}, text, source, 'review' FROM r WHERE {STRIP_SQL.format('text')} NOT IN (SELECT {STRIP_SQL.format('text')} FROM e)""")
def s1_merge_labels(spark, d):
    return labels.merge_labels(*_review(spark, d))


@query(f"""WITH {REVIEW} SELECT count(*) AS reviewed, count(*) FILTER (WHERE nullif({STRIP_SQL.format('yours')}, '') <> {STRIP_SQL.format('proposed')}) AS overridden, count(*) FILTER (WHERE {STRIP_SQL.format('text')} IN (SELECT {STRIP_SQL.format('text')} FROM e)) AS already_present FROM r""")
def s2_merge_report(spark, d):
    return labels.merge_report(*_review(spark, d))


@query("""WITH b AS (SELECT 0 AS p, doc_id AS i, text, 'real' AS source FROM documents UNION ALL SELECT 1, item_id, text, 'synthetic' FROM benchmark)
    SELECT row_number() OVER (ORDER BY p, i) AS feedback_id, md5(text) AS text_md5, source FROM b""")
def s3_union_corpus(spark, d):
    base = S.table(spark, d, "documents").select(F.col("doc_id").alias("feedback_id"), "text", F.lit("real").alias("source"))
    extra = S.table(spark, d, "benchmark").select(F.col("item_id").alias("feedback_id"), "text", F.lit("synthetic").alias("source"))
    return labels.union_corpus(base, extra).select("feedback_id", F.md5("text").alias("text_md5"), "source")


SHEET = """f AS (SELECT id, category, true AS m FROM pool WHERE category <> 'none' AND score >= 0.9), o AS (SELECT id, category, false AS m FROM pool WHERE NOT (category <> 'none' AND score >= 0.9) ORDER BY md5('42|' || id), id LIMIT 90), u AS (SELECT * FROM f UNION ALL SELECT * FROM o)"""


def _sheet(spark, d):
    pool = S.scored_documents(spark, d).withColumnRenamed("category", "proposed_label").withColumn("confidence", F.when(F.col("score") > 0.5, "high").otherwise("low"))
    hit = (F.col("proposed_label") != "none") & (F.col("score") >= 0.9)
    return labels.review_sheet(pool.where(hit), pool.where(~hit))


@query(with_("pool") + f", {SHEET} SELECT id, m AS model_flagged, row_number() OVER (ORDER BY m DESC, id) AS n FROM u")
def s4_review_sheet(spark, d):
    return _sheet(spark, d).select("id", "model_flagged", "n")


@query(with_("pool") + f", {SHEET} SELECT count(*) AS rows, count(*) FILTER (WHERE (u.category <> 'none') <> m) AS disagreements, count(*) FILTER (WHERE pool.score <= 0.5) AS not_high FROM u JOIN pool USING (id)")
def s4_review_counts(spark, d):
    return labels.review_counts(_sheet(spark, d))


# --- text ---------------------------------------------------------------------------------------


@query("""SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+')) > 6 OR regexp_matches(text, '[,;:]|\\s(and|but|also|however|although|though|while|plus)\\s|[.!?]\\s*[^\\s]', 'i') AS split, regexp_matches(text, '[\\x{0E00}-\\x{0E7F}]') AS thai,
    md5(array_to_string(list_sort(regexp_extract_all(lower(text), '[a-z0-9]+')), ' ')) AS key_md5 FROM documents WHERE text IS NOT NULL""")
def x1_text_rules(spark, d):
    """Needs splitting (X1), Thai routing (X2) and the content key (X12)."""
    t = F.col("text")
    return S.table(spark, d, "documents").where("text is not null").select("doc_id", X.needs_splitting(t).alias("split"), X.is_thai(t).alias("thai"), F.md5(X.content_key(t)).alias("key_md5"))


TEMPLATE, SYSTEM = "Split this: {text}", "You split answers."


@query(f"""WITH a AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, t, 'Split this: ' || t AS prompt FROM a WHERE len(regexp_extract_all(t, '[^\\s]+')) > 6 OR regexp_matches(t, '[,;:]|\\s(and|but|also|however|although|though|while|plus)\\s|[.!?]\\s*[^\\s]', 'i'))
    SELECT doc_id AS answer_id, md5(prompt) AS prompt_md5, CAST(greatest(256, least(greatest(512, 2 * (length(t) // 3 + 1)), 8192 - (length(prompt) + {len(SYSTEM)}) // 3)) AS INT) AS budget FROM p""")
def x3_split_requests(spark, d):
    a = S.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("answer_text"))
    return splitting.split_requests(a, TEMPLATE, SYSTEM).select("answer_id", F.md5("prompt").alias("prompt_md5"), "budget")


def _responses(spark, d):
    """Answers of a model, made from orders: lists, prose around lists, wrong types, broken text."""
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 7 == 0, F.concat(F.lit('["'), F.col("o_orderpriority"), F.lit('", " x "]'))).when(k % 7 == 1, F.concat(F.lit('Here: ["'), F.col("o_orderpriority"), F.lit('"] and ["y"]')))
        .when(k % 7 == 2, F.lit("[1, 2]")).when(k % 7 == 3, F.lit('["a", 1]')).when(k % 7 == 4, F.lit("[]")).when(k % 7 == 5, F.lit('["  "]')).otherwise(F.lit("no list"))
    )
    return S.table(spark, d, "orders").select(k.alias("answer_id"), raw.alias("raw"))


@query("""SELECT o_orderkey AS answer_id, CASE o_orderkey % 7 WHEN 0 THEN o_orderpriority || '|x' WHEN 1 THEN o_orderpriority ELSE '' END AS points,
    CASE WHEN o_orderkey % 7 IN (0, 4, 5) THEN 'ok' WHEN o_orderkey % 7 = 1 THEN 'ok_fallback' ELSE 'parse_error' END AS status FROM orders""")
def x4_parse_points(spark, d):
    return _responses(spark, d).withColumn("p", X.parse_points(F.col("raw"))).select("answer_id", F.array_join("p.points", "|").alias("points"), "p.status")


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, o_orderkey % 5 = 0 AS short, o_orderkey % 3 AS f, o_orderpriority AS p FROM orders),
    s AS (SELECT id, CASE WHEN short THEN 'short' WHEN f = 0 THEN (CASE WHEN id % 2 = 0 THEN 'decompose_gave_up' END) WHEN k = 0 THEN 'ok' WHEN k = 1 THEN 'ok_fallback' ELSE 'decompose_failed' END AS status, CASE WHEN NOT short AND f <> 0 AND k = 0 THEN 2 ELSE 1 END AS n FROM a)
    SELECT status, count(*) AS answers, CAST(sum(n) AS BIGINT) AS points FROM s WHERE status IS NOT NULL GROUP BY 1""")
def x7_apply_split_responses(spark, d):
    o = S.table(spark, d, "orders")
    a = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "good food").otherwise("good food, bad wifi").alias("answer_text"))
    attempts = o.select(F.col("o_orderkey").alias("answer_id"), F.when(F.col("o_orderkey") % 2 == 0, 3).otherwise(1).alias("failures"))
    split = splitting.apply_split_responses(a, _responses(spark, d).where("answer_id % 3 != 0"), attempts)
    return split.groupBy("status").agg(F.count(F.lit(1)).alias("answers"), F.sum(F.size("points")).alias("points"))


FUNC = "[" + ", ".join(f"'{w}'" for w in X.FUNCTION_WORDS) + "]"


@query(f"""WITH w AS (SELECT doc_id, text, {WORD_SET} AS src, regexp_extract_all(lower((SELECT max(text) FROM benchmark WHERE item_id = doc_id % (SELECT count(*) FROM benchmark))), '[a-z0-9'']+') AS pt FROM documents WHERE text IS NOT NULL),
    c AS (SELECT *, list_filter(pt, lambda x: NOT list_contains({FUNC}, x)) AS cw FROM w)
    SELECT doc_id, 2 * len(list_filter(cw, lambda x: list_contains(src, x))) >= len(cw) AS grounded FROM c""")
def x9_grounded(spark, d):
    points = S.table(spark, d, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("point"))
    docs = S.table(spark, d, "documents").where("text is not null").withColumn("k", F.col("doc_id") % points.count())
    return docs.join(points, "k").select("doc_id", X.grounded(F.array("point"), F.col("text")).alias("grounded"))


@query("""WITH k AS (SELECT doc_id, array_to_string(list_sort(regexp_extract_all(lower(text), '[a-z0-9]+')), ' ') AS k FROM documents WHERE text IS NOT NULL),
    r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r FROM k WHERE k NOT IN (SELECT array_to_string(list_sort(regexp_extract_all(lower(text), '[a-z0-9]+')), ' ') FROM benchmark)) SELECT doc_id AS feedback_id FROM r WHERE r = 1""")
def x13_dedupe_by_key(spark, d):
    new = S.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("feedback_id"), F.col("text").alias("raw_text"))
    return labels.dedupe_by_key(new, S.table(spark, d, "benchmark").select(F.col("text").alias("raw_text"))).select("feedback_id")


def _drawn(what: str) -> str:
    return f"(CAST('0x' || left(md5('42|{what}|' || id), 8) AS BIGINT) / 4294967296.0)"


JOINERS = ["{a} Also, {b}", "{a} {b}", "{a} And {b}"]
RULES = ["{nation} broke a rule.", "They threatened {nation}."]


def _sentence(which: str) -> str:
    return f"""s{which} AS (SELECT r.id, k.kind, replace(s.text, '{{nation}}', (SELECT p FROM np)[CAST(floor({_drawn(f'nation{which}')} * len((SELECT p FROM np))) AS BIGINT) + 1]) AS t
      FROM r JOIN k ON k.kind = CASE WHEN {_drawn(f'kind{which}')} < 1 / 3.0 THEN '0' WHEN {_drawn(f'kind{which}')} < 2 / 3.0 THEN '1' ELSE '2' END JOIN s ON s.kind = k.kind AND s.no = CAST(floor({_drawn(f'shape{which}')} * k.n) AS BIGINT))"""


@query(f"""WITH s AS (SELECT CAST(item_id % 3 AS VARCHAR) AS kind, text || ' {{nation}}.' AS text, row_number() OVER (PARTITION BY item_id % 3 ORDER BY text) - 1 AS no FROM benchmark WHERE text IS NOT NULL), k AS (SELECT kind, count(*) AS n FROM s GROUP BY 1),
    np AS (SELECT list(n_name ORDER BY n_name) AS p FROM (SELECT DISTINCT n_name FROM nation)), n AS (SELECT count(*) AS n FROM documents), r AS (SELECT unnest(range(0, 3 * n)) AS id FROM n), {_sentence('a')}, {_sentence('b')},
    m AS (SELECT a.id, CASE WHEN {_drawn('bad').replace('id)', 'a.id)')} < 0.06 THEN replace([{', '.join(map(repr, RULES))}][CAST(floor({_drawn('violation').replace('id)', 'a.id)')} * 2) AS BIGINT) + 1], '{{nation}}', (SELECT p FROM np)[CAST(floor({_drawn('nationv').replace('id)', 'a.id)')} * len((SELECT p FROM np))) AS BIGINT) + 1])
      WHEN {_drawn('multi').replace('id)', 'a.id)')} < 0.25 THEN replace(replace([{', '.join(map(repr, JOINERS))}][CAST(floor({_drawn('joiner').replace('id)', 'a.id)')} * 3) AS BIGINT) + 1], '{{a}}', a.t), '{{b}}', b.t) ELSE a.t END AS t, CASE WHEN {_drawn('bad').replace('id)', 'a.id)')} < 0.06 THEN 'violation' ELSE a.kind END AS kind FROM sa a JOIN sb b USING (id)),
    c AS (SELECT *, array_to_string(list_sort(regexp_extract_all(lower(t), '[a-z0-9]+')), ' ') AS c FROM m), e AS (SELECT array_to_string(list_sort(regexp_extract_all(lower(text), '[a-z0-9]+')), ' ') AS c FROM benchmark WHERE text IS NOT NULL),
    u AS (SELECT id, t, kind FROM c WHERE c NOT IN (SELECT c FROM e) QUALIFY row_number() OVER (PARTITION BY c ORDER BY id) = 1) SELECT id AS feedback_id, t AS raw_text, kind FROM u ORDER BY id LIMIT (SELECT n FROM n)""")
def x14_generate_feedback(spark, d):
    """As many synthetic rows as there are documents; shapes are benchmark texts and the slot is filled from nation names."""
    items = S.table(spark, d, "benchmark").where("text is not null")
    shapes = items.select((F.col("item_id") % 3).cast("string").alias("kind"), F.lit(1.0).alias("weight"), F.concat("text", F.lit(" {nation}.")).alias("text"))
    pool = [r[0] for r in S.table(spark, d, "nation").select("n_name").distinct().orderBy("n_name").collect()]  # a closed list
    n = S.table(spark, d, "documents").count()
    return splitting.generate_feedback(shapes, {"nation": pool}, n, violations=RULES, joiners=JOINERS, existing=items.select(F.col("text").alias("raw_text")))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS is_violation, CASE o_orderkey % 4 WHEN 0 THEN 'ethics' ELSE 'none' END AS category,
    CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN '' ELSE 'unparseable' END AS reason FROM orders""")
def x16_violation_from_category(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit('ok {"category": " Ethics ", "reason": "'), F.col("o_orderpriority"), F.lit('"}'))).when(k % 4 == 1, F.lit('{"category": "none"}')).when(k % 4 == 2, F.lit('{"category": "other"}')).otherwise(F.lit("[]"))
    return S.table(spark, d, "orders").select(k.alias("id"), X.violation_from_category(raw).alias("v")).select("id", "v.*")


@query("SELECT conv_id AS feedback_id, turn AS point_no, text AS point_text FROM conversations")
def io4_explode_points_json(spark, d):
    g = S.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("points"))
    return io.explode_points_json(g.select(F.col("conv_id").alias("feedback_id"), F.to_json("points").alias("points_json"))).withColumn("point_no", F.col("point_no").cast("long"))


@query("""SELECT o_custkey % 25 AS form_id, '{"n_points":' || count(*) || ',"min_cluster_size":8}' AS parameters FROM orders GROUP BY o_custkey % 25""")
def io8_run_record(spark, d):
    n = S.table(spark, d, "orders").groupBy((F.col("o_custkey") % 25).alias("form_id")).agg(F.count(F.lit(1)).alias("n_points")).withColumn("min_cluster_size", F.lit(8))
    now = F.lit(NOW).cast("timestamp")
    return io.run_record(n, ["n_points", "min_cluster_size"], now, now).select("form_id", "parameters")


@query(with_("points") + """, u AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'negative' END AS s FROM points WHERE id % 2 = 0)
    SELECT p.id, coalesce(u.s, sentiment_label) AS by_features, CASE WHEN u.id IS NOT NULL THEN u.s ELSE sentiment_label END AS by_labels FROM points p LEFT JOIN u ON u.id = p.id""")
def io9_keyed_updates(spark, d):
    p = S.points(spark, d)
    new = p.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "negative").alias("sentiment_label"))
    a = io.update_point_features(p, new).select("id", F.col("sentiment_label").alias("by_features"))
    return a.join(io.update_point_labels(p, new).select("id", F.col("sentiment_label").alias("by_labels")), "id")


@query(with_("points", "answers", "submissions") + f""", o AS (SELECT form_id, p.* FROM points p {OWNED}), u AS (SELECT *, CASE WHEN id % 2 = 0 THEN coalesce(CASE WHEN id % 4 = 0 THEN 'negative' END, sentiment_label) ELSE sentiment_label END AS one FROM o)
    SELECT form_id, id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 9 <> 0 THEN 'neutral' END ELSE one END AS sentiment_label, CASE WHEN id % 3 = 0 THEN 'none' ELSE violation_status END AS violation_status,
      CASE WHEN id % 5 = 0 THEN 'assigned' ELSE processing_status END AS processing_status, CASE WHEN id % 5 = 0 THEN 7::BIGINT ELSE canonical_topic_id END AS canonical_topic_id FROM u""")
def io9_merge_on_read(spark, d):
    """Three updates of some of the points, kept as change files; one form's are folded in between."""
    path = stage_path(spark, "points-table")
    own = queue.point_ownership(S.points(spark, d), S.answers(spark, d), S.submissions(spark, d)).drop("submission_id")
    changes.create(own, path)
    changes.write_change(own.where("id % 2 = 0").select("form_id", "id", F.when(F.col("id") % 4 == 0, "negative").alias("sentiment_label")), path, "features", 1)
    changes.write_change(own.where("id % 3 = 0").select("form_id", "id", F.when(F.col("id") % 9 != 0, "neutral").alias("sentiment_label"), F.lit("none").alias("violation_status")), path, "labels", 2)
    changes.fold_in(spark, path, 0.8)
    changes.write_change(own.where("id % 5 = 0").select("form_id", "id", F.lit("assigned").alias("processing_status"), F.lit(7).alias("canonical_topic_id")), path, "assignment", 3)
    return changes.read(spark, path).select(F.col("form_id").cast("long").alias("form_id"), "id", "sentiment_label", "violation_status", "processing_status", "canonical_topic_id")


@query(with_("points") + "SELECT id, sentiment_label, violation_status FROM points WHERE id % 3 = 0")
def io6_backup_rows(spark, d):
    """Rows saved before a change, read back."""
    path = stage_path(spark, "backup")
    io.backup_rows(S.points(spark, d).where("id % 3 = 0").select("id", "sentiment_label", "violation_status"), path)
    return spark.read.schema("id long, sentiment_label string, violation_status string").json(path)


@query(with_("points", "answers", "submissions") + "SELECT 'answers' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM answers UNION ALL SELECT 'points', count(*), CAST(sum(id) AS BIGINT) FROM points UNION ALL SELECT 'submissions', count(*), CAST(sum(id) AS BIGINT) FROM submissions")
def io3_read_tables(spark, d):
    """Tables of the survey model with their declared schemas."""
    path = stage_path(spark, "tables")
    made = {"answers": S.answers(spark, d), "points": S.points(spark, d), "submissions": S.submissions(spark, d)}
    for name, df in made.items():
        df.write.parquet(f"{path}/{name}.parquet")
    out = None
    for name, df in io.read_tables(spark, path, list(made)).items():
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
        out = row if out is None else out.unionByName(row)
    return out


# --- scoring ------------------------------------------------------------------------------------


@query(with_("points") + "SELECT id, CASE WHEN contains(point_text, 'error') THEN 'negative' WHEN contains(point_text, 'click') THEN 'positive' ELSE 'neutral' END AS sentiment FROM points")
def u1_score_distinct(spark, d):
    scorer = scoring.word_scorer({"error": "Negative ", "click": "positive"}, "neutral")
    return scoring.score_distinct(S.points(spark, d).select("id", "point_text"), scorer, "string").select("id", scoring.sentiment_label(F.col("score")).alias("sentiment"))


@query("""WITH s AS (SELECT event_id AS id, value / 1000 AS a, CASE WHEN event_id % 2 = 0 THEN 0.0795 ELSE 0.04 END AS b FROM events), m AS (SELECT id, a, b, greatest(a, b) AS s FROM s)
    SELECT id, round(s, 6) AS score, s >= 0.08 AS flagged, CASE WHEN s < 0.08 THEN 'none' WHEN a > b THEN 'ethics' ELSE 'legal' END AS category, CASE WHEN s < 0.08 THEN 'none' WHEN round(s, 3) >= 0.5 THEN 'violation' ELSE 'possible' END AS status, s >= 0.25 AS toxic FROM m""")
def u5_violation_rules(spark, d):
    """The strongest act (U5), its status (U6) and a toxicity flag (U7)."""
    e = S.table(spark, d, "events")
    scores = F.create_map(F.lit("cheating"), F.col("value") / 1000, F.lit("violence"), F.when(F.col("event_id") % 2 == 0, 0.0795).otherwise(0.04))
    best = e.select(F.col("event_id").alias("id"), scores.alias("s")).withColumn("b", scoring.best_violation(F.col("s"), {"cheating": "ethics", "violence": "legal"}))
    return best.select("id", F.round("b.score", 6).alias("score"), "b.flagged", "b.category", scoring.violation_status(F.col("b.score"), F.col("b.flagged")).alias("status"), scoring.toxicity_flag(F.col("s"), 0.25).alias("toxic"))


@query(with_("points") + "SELECT count(*) AS points, count(*) FILTER (WHERE NOT embedded OR processing_status = 'pending') AS pending, 0::BIGINT AS missing FROM points")
def u8_backfill(spark, d):
    out = scoring.backfill(S.points(spark, d), S.answers(spark, d), S.submissions(spark, d), None, scoring.word_scorer({}), scoring.hashing_encoder(8))
    return out.agg(F.count(F.lit(1)).alias("points"), F.count(F.when(F.col("processing_status") == "pending", 1)).alias("pending"), F.count(F.when(F.col("embedding").isNull(), 1)).alias("missing"))


ACTS = {"error": "legal", "click": "ethics"}


def _act_scores():
    """Scores by act of a text: what it names counts, a number of two digits counts more."""
    return lambda texts: [{act: (0.9 if t[-2:].strip().isdigit() and len(t[-2:].strip()) == 2 else 0.3) if act in t else 0.01 for act in ACTS} for t in texts]


RELABELLED = """CASE WHEN contains(point_text, 'view') THEN NULL WHEN contains(point_text, 'error') THEN 'negative' ELSE 'neutral' END AS s, contains(point_text, 'error') OR contains(point_text, 'click') AS bad, regexp_matches(point_text, ' [0-9]{2,}$') AS strong,
    CASE WHEN contains(point_text, 'error') THEN 'legal' WHEN contains(point_text, 'click') THEN 'ethics' ELSE 'none' END AS c"""


@query(with_("points") + f""", l AS (SELECT *, {RELABELLED} FROM points) SELECT id, CASE WHEN embedded THEN s ELSE sentiment_label END AS sentiment_label,
    CASE WHEN NOT embedded THEN violation_status WHEN NOT bad THEN 'none' WHEN strong THEN 'violation' ELSE 'possible' END AS violation_status, CASE WHEN embedded THEN c ELSE violation_type END AS violation_type FROM l""")
def u8_relabel(spark, d):
    """Fresh labels by both scorers; a label outside the vocabulary overwrites by null."""
    sentiment = scoring.word_scorer({"view": "no idea", "error": "Negative"}, "neutral")
    out = scoring.relabel(S.points(spark, d), S.answers(spark, d), S.submissions(spark, d), sentiment, _act_scores, ACTS)
    return out.select("id", "sentiment_label", "violation_status", "violation_type")


@query(with_("points") + f""", l AS (SELECT *, {RELABELLED} FROM points) SELECT id, CASE WHEN embedded THEN sentiment_label ELSE coalesce(s, sentiment_label) END AS sentiment_label,
    CASE WHEN embedded THEN violation_status WHEN NOT bad THEN 'none' WHEN strong THEN 'violation' ELSE 'possible' END AS violation_status, CASE WHEN embedded THEN processing_status ELSE 'pending' END AS processing_status FROM l""")
def u8_backfill_labels(spark, d):
    """Features of points without a vector, by an encoder and both scorers; a null keeps the old label."""
    sentiment = scoring.word_scorer({"view": "no idea", "error": "Negative"}, "neutral")
    out = scoring.backfill(S.points(spark, d), S.answers(spark, d), S.submissions(spark, d), sentiment, _act_scores, ACTS, scoring.hashing_encoder(8))
    return out.select("id", "sentiment_label", "violation_status", "processing_status")


# --- vectors and clusters -----------------------------------------------------------------------

DIMS = "x AS (SELECT form_id, topic_key, id, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM vectors), c AS (SELECT form_id, topic_key, dim, avg(v) AS c FROM x GROUP BY ALL)"


@query(with_("vectors") + f", {DIMS} SELECT form_id, topic_key, CAST(dim AS INT) AS dim, round(c, 6) AS value FROM c")
def v1_centroids(spark, d):
    return vectors.centroids(S.vectors(spark, d), "form_id", "topic_key").select("form_id", "topic_key", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(with_("vectors") + f", {DIMS} SELECT x.form_id, x.id, round(sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))), 6) AS confidence FROM x JOIN c USING (form_id, topic_key, dim) GROUP BY 1, 2")
def v2_confidence(spark, d):
    v = S.vectors(spark, d)
    return vectors.confidence(v, vectors.centroids(v, "form_id", "topic_key"), "form_id", "topic_key").select("form_id", "id", F.round("confidence", 6).alias("confidence"))


@query("SELECT o_custkey AS k, count(*) AS n, CAST(greatest(8, round_even(count(*) * 40 / 100.0, 0)) AS INT) AS min_size FROM orders GROUP BY 1")
def v3_min_cluster_size(spark, d):
    n = S.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("min_size", vectors.min_cluster_size(F.col("n"), percent=40.0))


PAIRS = "pr AS (SELECT x.form_id, x.id AS a, y.id AS b, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS s FROM vectors x JOIN vectors y ON x.form_id = y.form_id AND x.id < y.id)"


@query(with_("vectors") + f", {PAIRS} SELECT form_id, a, b, round(s, 6) AS similarity FROM pr WHERE s >= 0.35")
def j6_radius_join(spark, d):
    return vectors.radius_join(S.vectors(spark, d), 0.35).withColumn("similarity", F.round("similarity", 6))


@query(with_("vectors") + f""", {PAIRS}, n AS (SELECT form_id, a AS id, b AS neighbour, s FROM pr UNION ALL SELECT form_id, b, a, s FROM pr),
    r AS (SELECT *, row_number() OVER (PARTITION BY form_id, id ORDER BY s DESC, neighbour) AS place FROM n) SELECT form_id, id, neighbour, CAST(place AS INT) AS place FROM r WHERE place <= 5""")
def j7_knn_join(spark, d):
    return vectors.knn_join(S.vectors(spark, d), 5).select("form_id", "id", "neighbour", "place")


@query(with_("vectors") + f", {PAIRS} SELECT form_id, count(*) AS pairs, 0::BIGINT AS wrong, true AS found FROM pr WHERE s >= 0.35 GROUP BY 1")
def j6_similar_pairs(spark, d):
    """The index against the exact join: pairs, found pairs below the threshold, and whether 95 % or more are found."""
    v = S.vectors(spark, d)
    exact = vectors.radius_join(v, 0.35).select("form_id", "a", "b", F.lit(1).alias("true"))
    found = neighbours.similar_pairs(v, 0.35, recall=0.9995).select("form_id", "a", "b", F.lit(1).alias("got"))
    both = exact.join(found, ["form_id", "a", "b"], "full").groupBy("form_id").agg(F.count("true").alias("pairs"), F.count(F.when(F.col("true").isNull(), 1)).alias("wrong"), F.count(F.when(F.col("true") == F.col("got"), 1)).alias("hit"))
    return both.select("form_id", "pairs", "wrong", (F.col("hit") >= 0.95 * F.col("pairs")).alias("found"))


@query(with_("vectors") + "SELECT form_id, CAST(sum(least(n - 1, 5) * n) AS BIGINT) AS neighbours, true AS found FROM (SELECT form_id, count(*) AS n FROM vectors GROUP BY 1) GROUP BY 1")
def j7_knn_graph(spark, d):
    """Graph refinement against the exact join: neighbours of all points, and whether 95 % or more are the exact ones."""
    v = S.vectors(spark, d)
    near = neighbours.knn_graph(v, 5).select("form_id", "id", "neighbour")
    hit = near.join(vectors.knn_join(v, 5).select("form_id", "id", "neighbour", F.lit(1).alias("true")), ["form_id", "id", "neighbour"], "left")
    return hit.groupBy("form_id").agg(F.count(F.lit(1)).alias("neighbours"), (F.count("true") >= 0.95 * F.count(F.lit(1))).alias("found"))


@query(with_("vectors") + f""", n AS (SELECT form_id, id, embedding, CASE WHEN id % 4 = 0 THEN NULL ELSE topic_key END AS topic_key FROM vectors), x AS (SELECT form_id, topic_key, id, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM n),
    c AS (SELECT form_id, topic_key, dim, avg(v) AS c FROM x WHERE topic_key IS NOT NULL GROUP BY ALL), m AS (SELECT form_id, topic_key, sqrt(sum(c * c)) AS m FROM c GROUP BY 1, 2),
    s AS (SELECT x.form_id, x.id, c.topic_key, sum(v * c / m) AS s FROM x JOIN c ON x.form_id = c.form_id AND x.dim = c.dim JOIN m ON m.form_id = c.form_id AND m.topic_key = c.topic_key WHERE x.topic_key IS NULL GROUP BY 1, 2, 3),
    b AS (SELECT form_id, id, arg_max(topic_key, s) AS t, max(s) AS s FROM s GROUP BY 1, 2)
    SELECT n.form_id, n.id, coalesce(n.topic_key, CASE WHEN b.s >= 0.3 THEN b.t END) AS topic_key FROM n LEFT JOIN b USING (form_id, id)""")
def v5_reassign_outliers(spark, d):
    v = S.vectors(spark, d).withColumn("topic_key", F.when(F.col("id") % 4 != 0, F.col("topic_key")))
    return vectors.reassign_outliers(v).select("form_id", "id", "topic_key")


@query("WITH RECURSIVE " + with_("vectors")[5:] + f""", {PAIRS}, e AS (SELECT a, b FROM pr WHERE s >= 0.35 UNION SELECT b, a FROM pr WHERE s >= 0.35), c(id, r) AS (SELECT a, a FROM e UNION SELECT c.id, e.b FROM c JOIN e ON c.r = e.a) SELECT id, min(r) AS component FROM c GROUP BY 1""")
def v6_connected_components(spark, d):
    return components.connected_components(vectors.radius_join(S.vectors(spark, d), 0.35))


@query("WITH RECURSIVE " + with_("vectors")[5:] + f""", {PAIRS}, n AS (SELECT form_id, id, CASE WHEN id % 4 = 0 THEN NULL ELSE topic_key END AS topic_key, id % 100 / 100.0 AS confidence FROM vectors), e AS (SELECT a, b FROM pr WHERE s >= 0.35 UNION SELECT b, a FROM pr WHERE s >= 0.35),
    c(id, r) AS (SELECT a, a FROM e UNION SELECT c.id, e.b FROM c JOIN e ON c.r = e.a), g AS (SELECT id, min(r) AS g FROM c GROUP BY 1), h AS (SELECT g, arg_min(topic_key, (-confidence, n.id)) AS home FROM g JOIN n USING (id) WHERE topic_key IS NOT NULL GROUP BY 1)
    SELECT n.form_id, n.id, coalesce(home, topic_key) AS topic_key, CAST(CASE WHEN topic_key IS NULL AND home IS NOT NULL THEN 0 ELSE confidence END AS DOUBLE) AS confidence FROM n LEFT JOIN g USING (id) LEFT JOIN h USING (g)""")
def v7_merge_near_duplicates(spark, d):
    v = S.vectors(spark, d).withColumn("topic_key", F.when(F.col("id") % 4 != 0, F.col("topic_key"))).withColumn("confidence", F.col("id") % 100 / 100.0)
    return clustering.merge_near_duplicates(v, 0.35).select("form_id", "id", "topic_key", "confidence")


def _density(source: str, min_size: int, min_pts: int) -> str:
    """CTEs that end in ``dl``: ``grp, id, label`` of the rows ``grp, id, embedding`` of ``source``."""
    return f"""dp AS (SELECT x.grp, x.id AS a, y.id AS b, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS s FROM {source} x JOIN {source} y ON x.grp = y.grp AND x.id < y.id),
    dn AS (SELECT grp, a AS id, b AS o, s, sqrt(greatest(2 - 2 * s, 0)) AS d FROM dp UNION ALL SELECT grp, b, a, s, sqrt(greatest(2 - 2 * s, 0)) FROM dp), dk AS (SELECT *, row_number() OVER (PARTITION BY grp, id ORDER BY round(d, 9), o) AS p FROM dn),
    dq AS (SELECT grp, quantile_disc(d, 0.5) AS q FROM dk WHERE p = {min_pts} GROUP BY 1), dt AS (SELECT dn.* FROM dn JOIN dq USING (grp) WHERE 1 - s <= q * q / 2 + 1e-12),
    dc AS (SELECT id FROM dt GROUP BY id HAVING count(*) >= {min_pts}), de AS (SELECT id, o FROM dt WHERE id IN (SELECT id FROM dc) AND o IN (SELECT id FROM dc)),
    dr(id, r) AS (SELECT id, id FROM dc UNION SELECT dr.id, de.o FROM dr JOIN de ON dr.r = de.id), dg AS (SELECT id, min(r) AS g FROM dr GROUP BY 1),
    db AS (SELECT id, arg_min(o, (-round(s, 9), o)) AS o FROM dt WHERE id NOT IN (SELECT id FROM dc) AND o IN (SELECT id FROM dc) GROUP BY 1), dm AS (SELECT * FROM dg UNION ALL SELECT db.id, g FROM db JOIN dg ON db.o = dg.id),
    dz AS (SELECT g, any_value(grp) AS grp, min(id) AS first FROM dm JOIN {source} USING (id) GROUP BY g HAVING count(*) >= {min_size}), dw AS (SELECT g, row_number() OVER (PARTITION BY grp ORDER BY first) - 1 AS label FROM dz),
    dl AS (SELECT x.grp, x.id, coalesce(label, -1) AS label FROM {source} x LEFT JOIN dm USING (id) LEFT JOIN dw USING (g))"""


@query("WITH RECURSIVE " + with_("vectors")[5:] + f", src AS (SELECT form_id AS grp, id, embedding FROM vectors), {_density('src', 8, 4)} SELECT grp AS form_id, id, CAST(label AS BIGINT) AS label FROM dl")
def v4_density_cluster(spark, d):
    return clustering.density_cluster(S.vectors(spark, d), 8, 4)


@query("WITH RECURSIVE " + with_("vectors")[5:] + f""", src AS (SELECT form_id || '.' || topic_key AS grp, id, embedding FROM vectors QUALIFY count(*) OVER (PARTITION BY form_id, topic_key) >= 8), {_density('src', 4, 2)},
    o AS (SELECT *, max(label) OVER (PARTITION BY grp) AS parts, count(*) FILTER (WHERE label = -1) OVER (PARTITION BY grp) AS rest FROM dl)
    SELECT form_id, id, CASE WHEN label IS NULL OR parts < 0 THEN topic_key WHEN label >= 0 THEN topic_key || '.' || label WHEN rest >= 4 THEN topic_key END AS topic_key FROM vectors LEFT JOIN o USING (id)""")
def v8_split_large_topics(spark, d):
    return clustering.split_large_topics(S.vectors(spark, d), 4, 2).select("form_id", "id", "topic_key")


RATIOS = ", ".join(map(str, clustering.SWEEP_RATIOS))


@query("WITH RECURSIVE " + with_("vectors")[5:] + f""", src AS (SELECT form_id AS grp, id, embedding FROM vectors), {_density('src', 1, 5)}, nf AS (SELECT form_id, count(*) AS n FROM vectors GROUP BY 1),
    ts AS (SELECT DISTINCT form_id, n, CAST(greatest(2, round_even(n * r, 0)) AS INT) AS m FROM nf, (SELECT unnest([{RATIOS}]::DOUBLE[]) AS r) WHERE CAST(greatest(2, round_even(n * r, 0)) AS INT) < n // 2), gs AS (SELECT form_id, g, count(*) AS size FROM dm JOIN vectors USING (id) GROUP BY 1, 2),
    lb AS (SELECT ts.form_id, ts.m, v.id, v.embedding, CASE WHEN size >= m THEN dm.g END AS g FROM ts JOIN vectors v USING (form_id) LEFT JOIN dm USING (id) LEFT JOIN gs ON gs.form_id = ts.form_id AND gs.g = dm.g),
    lx AS (SELECT form_id, m, id, g, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM lb), lc AS (SELECT form_id, m, g, dim, avg(v) AS c FROM lx WHERE g IS NOT NULL GROUP BY ALL), ln AS (SELECT form_id, m, g, sqrt(sum(c * c)) AS l FROM lc GROUP BY ALL),
    ls AS (SELECT x.form_id, x.m, x.id, c.g, sum(v * c / l) / sqrt(sum(v * v)) AS s FROM lx x JOIN lc c ON x.form_id = c.form_id AND x.m = c.m AND x.dim = c.dim JOIN ln n ON n.form_id = c.form_id AND n.m = c.m AND n.g = c.g WHERE x.g IS NULL GROUP BY ALL),
    la AS (SELECT form_id, m, id, arg_max(g, s) AS g FROM ls WHERE s >= 0.3 GROUP BY ALL), lf AS (SELECT lb.form_id, lb.m, lb.g AS before, coalesce(lb.g, la.g) AS g FROM lb LEFT JOIN la USING (form_id, m, id)),
    lo AS (SELECT form_id, m, g, count(*) AS size, count(before) AS inside FROM lf GROUP BY ALL)
    SELECT form_id, m AS min_size, CAST(sum(size) AS BIGINT) AS n, count(g) AS topics, round(1 - sum(inside) / sum(size), 6) AS outlier_before, round(coalesce(sum(size) FILTER (WHERE g IS NULL), 0) / sum(size), 6) AS outlier_rate, round(max(size) FILTER (WHERE g IS NOT NULL) / sum(size), 6) AS largest_share FROM lo GROUP BY 1, 2""")
def v14_parameter_sweep(spark, d):
    """All candidate sizes of every form; vectors with the text of the document of the same number."""
    v = S.vectors(spark, d)
    texts = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("point_text"))
    # most documents have no vector, and their texts need not be shuffled
    swept = clustering.parameter_sweep(v.join(io.rows_with(texts, v.select("id")), "id", "left"))
    return swept.select("form_id", "min_size", "n", "topics", "outlier_before", "outlier_rate", "largest_share")


@query(with_("vectors") + f""", {PAIRS}, n AS (SELECT form_id, a AS id, b AS o, s FROM pr UNION ALL SELECT form_id, b, a, s FROM pr), r AS (SELECT *, row_number() OVER (PARTITION BY form_id, id ORDER BY s DESC, o) AS p FROM n),
    q AS (SELECT r.form_id, r.id, avg(CAST(x.topic_key = y.topic_key AS INT)) AS share FROM r JOIN vectors x ON x.id = r.id JOIN vectors y ON y.id = r.o WHERE p <= 5 GROUP BY 1, 2) SELECT form_id, round(avg(share), 6) AS purity FROM q GROUP BY 1""")
def v15_knn_purity(spark, d):
    v = S.vectors(spark, d)
    own = v.select("form_id", "id", F.col("topic_key").cast("long").alias("label"))
    return clustering.knn_purity(v.select("form_id", "id", "embedding"), own.select("id", "label")).withColumn("purity", F.round("purity", 6))


@query("WITH RECURSIVE vectors AS (SELECT vec_id AS id, embedding FROM embeddings), " + """o AS (SELECT id, embedding, row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS r, count(*) OVER () AS n FROM vectors),
    f AS (SELECT f, id, embedding FROM o, (VALUES (0.15::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) AS t(f) WHERE r < floor(n * f)),
    p AS (SELECT x.f, x.id AS a, y.id AS b, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS s FROM f x JOIN f y ON x.f = y.f AND x.id <> y.id), t AS (SELECT * FROM p WHERE 1 - s <= 0.7 + 1e-12),
    c AS (SELECT f, a AS id FROM t GROUP BY 1, 2 HAVING count(*) >= 8), e AS (SELECT t.f, a, b FROM t JOIN c x ON x.f = t.f AND x.id = a JOIN c y ON y.f = t.f AND y.id = b), r(f, id, r) AS (SELECT f, id, id FROM c UNION SELECT r.f, r.id, e.b FROM r JOIN e ON r.f = e.f AND r.r = e.a),
    g AS (SELECT f, id, min(r) AS g FROM r GROUP BY 1, 2), d AS (SELECT t.f, a AS id, arg_min(b, (-round(s, 9), b)) AS o FROM t JOIN c y ON y.f = t.f AND y.id = b ANTI JOIN c x ON x.f = t.f AND x.id = a GROUP BY 1, 2),
    m AS (SELECT * FROM g UNION ALL SELECT d.f, d.id, g FROM d JOIN g ON g.f = d.f AND g.id = d.o), z AS (SELECT f, g FROM m GROUP BY 1, 2 HAVING count(*) >= 8), l AS (SELECT m.f, m.id, m.g FROM m JOIN z USING (f, g)),
    k AS (SELECT p.f, a, x.g = y.g AS same, row_number() OVER (PARTITION BY p.f, a ORDER BY round(sqrt(greatest(2 - 2 * s, 0)), 9), b) AS q FROM p JOIN l x ON x.f = p.f AND x.id = a JOIN l y ON y.f = p.f AND y.id = b),
    u AS (SELECT f, avg(h) AS purity FROM (SELECT f, a, avg(CAST(same AS INT)) AS h FROM k WHERE q <= 5 GROUP BY 1, 2) GROUP BY 1), w AS (SELECT f, count(*) AS n, count(DISTINCT g) AS topics FROM l GROUP BY 1), v AS (SELECT f, count(*) AS n FROM f GROUP BY 1)
    SELECT v.f AS fraction, CAST(v.n AS BIGINT) AS n, coalesce(topics, 0) AS topics, round(1 - coalesce(w.n, 0) / v.n, 6) AS outlier_rate, round(CASE WHEN w.n > 6 THEN purity END, 6) AS purity FROM v LEFT JOIN w USING (f) LEFT JOIN u USING (f)""")
def v16_growth_curve(spark, d):
    """All vectors as one form, at a fixed limit."""
    prefixes = labels.growth_prefixes(S.vectors(spark, d).select("id", "embedding"))
    curve = clustering.growth_curve(prefixes, 8, eps=0.7)
    return curve.select("fraction", "n", "topics", "outlier_rate", F.round("purity", 6).alias("purity"))


TERMS = """w AS (SELECT lang AS t, regexp_extract_all(lower(text), '[a-z0-9_]{2,}') AS w FROM documents WHERE text IS NOT NULL),
    g AS (SELECT t, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w), tc AS (SELECT t, term, count(*) AS n FROM g GROUP BY 1, 2)"""


@query(f"WITH {TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, term) AS place FROM tc) SELECT t AS lang, term, n, CAST(place AS INT) AS place FROM r WHERE place <= 10")
def v9_top_words(spark, d):
    return words.top_words(S.table(spark, d, "documents").where("text is not null"), 10, "lang", stop=[])


STOP = ["the", "of", "and", "die", "und", "le", "el"]
_UNSTOPPED = "regexp_extract_all(lower(text), '[a-z0-9_]{2,}')"
STOPPED = TERMS.replace(_UNSTOPPED, f"list_filter({_UNSTOPPED}, lambda x: x NOT IN ({', '.join(map(repr, STOP))}))")


@query(f"WITH {STOPPED}, r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, term) AS place FROM tc) SELECT t AS lang, term, n, CAST(place AS INT) AS place FROM r WHERE place <= 10")
def v9_top_words_stop(spark, d):
    return words.top_words(S.table(spark, d, "documents").where("text is not null"), 10, "lang", stop=STOP)


TFIDF = f"""{TERMS}, s AS (SELECT t, sum(n) AS s FROM tc GROUP BY 1), a AS (SELECT term, sum(n) AS a FROM tc GROUP BY 1), x AS (SELECT tc.t, tc.term, sqrt(n / s) * ln(1 + (SELECT avg(s) FROM s) / a) AS weight FROM tc JOIN s USING (t) JOIN a USING (term)),
    k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(weight, 9) DESC, term) AS place FROM x)"""


def _tfidf(spark, d):
    return words.class_tfidf(S.table(spark, d, "documents").where("text is not null"), "lang", stop=[])


@query(f"WITH {TFIDF} SELECT t AS lang, term, round(weight, 6) AS weight, CAST(place AS INT) AS place FROM k WHERE place <= 10")
def v10_class_tfidf(spark, d):
    return _tfidf(spark, d).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {TFIDF}, l AS (SELECT DISTINCT t, term FROM k WHERE place <= 10), h AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]{{1,}}')) AS term FROM documents) WHERE term IN (SELECT term FROM l)),
    f AS (SELECT term, count(*) AS f FROM h GROUP BY 1), b AS (SELECT x.term AS p, y.term AS q, count(*) AS b FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
    v AS (SELECT x.t, CASE WHEN b.b IS NULL THEN -1 WHEN b.b = n.n THEN 1 ELSE ln((b.b / n.n) / ((fx.f / n.n) * (fy.f / n.n))) / -ln(b.b / n.n) END AS v FROM l x JOIN l y ON x.t = y.t AND x.term < y.term JOIN f fx ON fx.term = x.term JOIN f fy ON fy.term = y.term LEFT JOIN b ON b.p = x.term AND b.q = y.term, n)
    SELECT t AS lang, round(avg(v), 6) AS npmi FROM v GROUP BY 1""")
def v12_npmi(spark, d):
    docs = S.table(spark, d, "documents").where("text is not null")
    return words.npmi_by_topic(_tfidf(spark, d), docs, "lang", id_col="doc_id").withColumn("npmi", F.round("npmi", 6))


@query(f"WITH {TFIDF} SELECT round(count(DISTINCT term) / count(*), 6) AS diversity FROM k WHERE place <= 10")
def v13_topic_diversity(spark, d):
    return words.topic_diversity(_tfidf(spark, d)).withColumn("diversity", F.round("diversity", 6))


@query(f"""WITH {TERMS}, r AS (SELECT t, term, row_number() OVER (PARTITION BY t ORDER BY n DESC, term) AS place FROM tc), f AS (SELECT t, string_agg(term, ', ' ORDER BY place) AS f FROM r WHERE place <= 3 GROUP BY 1)
    SELECT t AS lang, CASE WHEN t = 'en' THEN 'own, words' ELSE f END AS name FROM f""")
def v11_keyword_fallback(spark, d):
    top = words.top_words(S.table(spark, d, "documents").where("text is not null"), 3, "lang", stop=[])
    frequent = top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda s: s["term"]).alias("words"))
    own = frequent.select("lang", F.when(F.col("lang") == "en", F.array(F.lit("own"), F.lit("words"))).otherwise(F.array().cast("array<string>")).alias("words"))
    parent = own.where("false")
    return words.keyword_fallback(own, parent, frequent, "lang").select("lang", X.topic_name(F.col("words")).alias("name"))


# --- round trips of sources and sinks -----------------------------------------------------------


@query(with_("answers") + """SELECT id, answer_text || chr(10) || 'a "quoted" line' AS raw_text FROM answers WHERE regexp_replace(answer_text, '\\s+', '', 'g') <> ''""")
def io1_read_feedback_csv(spark, d):
    path = stage_path(spark, "csv")
    text = F.col("answer_text")
    full = F.when(F.trim(F.regexp_replace(text, "\\s+", "")) == "", text).otherwise(F.concat(F.lit(" "), text, F.lit('\na "quoted" line ')))
    S.answers(spark, d).select("id", full.alias("raw_text")).write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return io.read_feedback_csv(spark, path).select(F.col("id").cast("long").alias("id"), "raw_text")


@query(with_("points") + "SELECT id, point_text, sentiment_label FROM points")
def io5_points_export(spark, d):
    path = stage_path(spark, "export")
    io.write_points_export(S.points(spark, d).select("id", "point_text", "sentiment_label", F.lit("not exported").alias("answer_text")), path)
    return spark.read.schema("id long, point_text string, sentiment_label string").csv(path, header=True)


@query("""SELECT o_orderstatus AS variant, o_orderkey AS feedback_id, o_orderpriority AS raw_text, '["' || o_orderpriority || '","' || o_orderstatus || '"]' AS points_json, CAST(2 AS INT) AS n_points, 'ok' AS status FROM orders""")
def io7_write_decomposed(spark, d):
    path = stage_path(spark, "decomposed")
    rows = S.table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("variant"), F.col("o_orderkey").alias("feedback_id"), F.col("o_orderpriority").alias("raw_text"), F.array("o_orderpriority", "o_orderstatus").alias("points"), F.lit("ok").alias("status"),
    )
    io.write_decomposed(rows, path)
    return spark.read.parquet(path)


# --- identity -----------------------------------------------------------------------------------


def _identity_inputs(spark, d):
    """Old topics from the first letter of things, new groups that cut across them."""
    own = queue.point_ownership(S.points(spark, d), S.answers(spark, d), S.submissions(spark, d))
    k = F.regexp_extract("point_text", " ([0-9]+)$", 1).cast("long")
    new = F.when(k % 10 == 9, None).when(k < 30, F.concat(F.lit("g"), F.floor(k / 3).cast("string"))).when(k < 60, F.concat(F.lit("m"), F.floor(k / 10).cast("string"))).otherwise(F.concat(F.lit("n"), (k % 7).cast("string")))
    assigned = own.select("form_id", "id", new.alias("topic_key"))
    previous = own.where("canonical_topic_id is not null").select("id", F.floor(F.col("canonical_topic_id") / 2).alias("old_topic_id"))
    topics = own.select("form_id").distinct().withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(24)))).select("form_id", F.col("id").cast("long"))
    return assigned, previous, topics


IDENT = with_("points", "answers", "submissions") + f""", o AS (SELECT form_id, p.id, canonical_topic_id, CAST(regexp_extract(point_text, ' ([0-9]+)$', 1) AS BIGINT) AS k FROM points p {OWNED}),
    n AS (SELECT form_id, id, CASE WHEN k % 10 = 9 THEN NULL WHEN k < 30 THEN 'g' || (k // 3) WHEN k < 60 THEN 'm' || (k // 10) ELSE 'n' || (k % 7) END AS g, CASE WHEN canonical_topic_id IS NOT NULL AND canonical_topic_id // 2 <= 24 THEN canonical_topic_id // 2 END AS t FROM o),
    c AS (SELECT form_id, t, g, count(*) AS shared FROM n WHERE t IS NOT NULL GROUP BY ALL), z AS (SELECT *, sum(shared) OVER (PARTITION BY form_id, t) AS size FROM c), sh AS (SELECT form_id, t, g, shared, shared / size AS share FROM z WHERE g IS NOT NULL),
    b AS (SELECT *, row_number() OVER (PARTITION BY form_id, g ORDER BY share DESC, t) AS r FROM sh), q AS (SELECT *, row_number() OVER (PARTITION BY form_id, t ORDER BY share DESC, shared DESC, g) AS w FROM b WHERE r = 1 AND share >= 0.5), ca AS (SELECT form_id, t, g FROM q WHERE w = 1),
    mo AS (SELECT sh.form_id, sh.t, ca.t AS s, share, row_number() OVER (PARTITION BY sh.form_id, sh.t ORDER BY share DESC, ca.t) AS r FROM sh JOIN ca ON sh.form_id = ca.form_id AND sh.g = ca.g WHERE share >= 0.2 AND NOT EXISTS (SELECT 1 FROM ca x WHERE x.form_id = sh.form_id AND x.t = sh.t)), me AS (SELECT form_id, t, s FROM mo WHERE r = 1),
    tp AS (SELECT form_id, u AS t FROM (SELECT DISTINCT form_id FROM o), range(25) AS x(u)) """


@query(IDENT + "SELECT form_id, t AS old_topic_id, g AS topic_key, shared, round(share, 6) AS share FROM sh")
def i1_containment(spark, d):
    return identity.containment(*_identity_inputs(spark, d)).select("form_id", "old_topic_id", "topic_key", "shared", F.round("share", 6).alias("share"))


@query(IDENT + "SELECT form_id, t AS old_topic_id, g AS topic_key FROM ca")
def i2_claims(spark, d):
    return identity.claims(identity.containment(*_identity_inputs(spark, d))).select("form_id", "old_topic_id", "topic_key")


@query(IDENT + "SELECT form_id, t AS old_topic_id, s AS survivor_id FROM me")
def i3_merged(spark, d):
    return identity.resolve_identity(*_identity_inputs(spark, d)).merged.select("form_id", "old_topic_id", "survivor_id")


@query(IDENT + "SELECT form_id, t AS old_topic_id, count(*) AS parts FROM sh WHERE share >= 0.2 GROUP BY 1, 2 HAVING count(*) > 1")
def i4_split_events(spark, d):
    return identity.resolve_identity(*_identity_inputs(spark, d)).split.select("form_id", "old_topic_id", "parts")


@query(IDENT + """, a AS (SELECT form_id, 'carried' AS outcome FROM ca UNION ALL SELECT form_id, 'merged' FROM me UNION ALL SELECT form_id, 'split' FROM (SELECT form_id, t FROM sh WHERE share >= 0.2 GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT form_id, 'dissolved' FROM tp WHERE (form_id, t) NOT IN (SELECT (form_id, t) FROM ca) AND (form_id, t) NOT IN (SELECT (form_id, t) FROM me) UNION ALL SELECT form_id, 'new' FROM (SELECT DISTINCT form_id, g FROM n WHERE g IS NOT NULL) WHERE (form_id, g) NOT IN (SELECT (form_id, g) FROM ca))
    SELECT form_id, outcome, count(*) AS topics FROM a GROUP BY 1, 2""")
def i6_identity_outcomes(spark, d):
    """Counts of all outcomes (I5 to I7)."""
    return identity.outcomes(identity.resolve_identity(*_identity_inputs(spark, d)))


@query(IDENT + "SELECT form_id, t AS old_topic_id, g AS topic_key FROM ca WHERE (form_id, t) IN (SELECT (form_id, s) FROM me)")
def i6_widened(spark, d):
    return identity.widened(identity.resolve_identity(*_identity_inputs(spark, d))).select("form_id", "old_topic_id", "topic_key")


@query(IDENT + "SELECT n.form_id, n.id, CASE WHEN ca.t IS NULL THEN 'unknown' ELSE 'assigned' END AS processing_status, ca.t AS canonical_topic_id, CAST(CASE WHEN ca.t IS NOT NULL THEN 1 END AS DOUBLE) AS assignment_confidence FROM n LEFT JOIN ca ON n.form_id = ca.form_id AND n.g = ca.g")
def i8_final_assignments(spark, d):
    a, p, t = _identity_inputs(spark, d)
    ids = identity.claims(identity.containment(a, p, t)).select("form_id", "topic_key", F.col("old_topic_id").alias("topic_id"))
    return identity.final_assignments(a.withColumn("confidence", F.lit(1.0)), ids)


# --- label quality ------------------------------------------------------------------------------


@query(with_("queue") + "SELECT count(*) AS labelled, count(*) FILTER (WHERE label = '1') AS positive, count(*) FILTER (WHERE label = '0') AS negative, count(*) FILTER (WHERE label = 'unsure') AS unsure, round(count(*) FILTER (WHERE label = '1') / (count(*) FILTER (WHERE label = '1') + count(*) FILTER (WHERE label = '0')), 6) AS positive_rate FROM queue WHERE label <> ''")
def l1_label_counts(spark, d):
    return labels.label_counts(S.labels(spark, d))


@query(with_("queue") + """, g AS (SELECT split_part(id, '#', 1) AS i, count(*) AS n, count(DISTINCT label) = 1 AS c FROM queue WHERE label <> '' GROUP BY 1 HAVING count(*) > 1), s AS (SELECT count(*) AS repeated, round(avg(CAST(c AS INT)), 6) AS share FROM g)
    SELECT repeated, share, CASE WHEN share >= 0.85 THEN 'reliable' WHEN share >= 0.75 THEN 'usable' ELSE 'unreliable' END AS verdict FROM s""")
def l2_label_consistency(spark, d):
    return labels.label_consistency(S.labels(spark, d))


CONF = "count(*) FILTER (WHERE {l} AND {s}) AS tp, count(*) FILTER (WHERE NOT ({l}) AND {s}) AS fp, count(*) FILTER (WHERE {l} AND NOT ({s})) AS fn, count(*) FILTER (WHERE NOT ({l}) AND NOT ({s})) AS tn, round(count(*) FILTER (WHERE {l} AND {s}) / nullif(count(*) FILTER (WHERE {s}), 0), 6) AS precision, round(count(*) FILTER (WHERE {l} AND {s}) / nullif(count(*) FILTER (WHERE {l}), 0), 6) AS recall, round(2 * count(*) FILTER (WHERE {l} AND {s}) / nullif(count(*) FILTER (WHERE {s}) + count(*) FILTER (WHERE {l}), 0), 6) AS f1"


@query(with_("queue", "pool") + f", {DECIDED} SELECT {CONF.format(l='label = 1', s='score >= 0.75')} FROM j")
def l3_agreement(spark, d):
    return labels.agreement(S.labels(spark, d), S.scored_documents(spark, d))


def _cases(spark, d):
    p = S.scored_documents(spark, d)
    return p.select("id", F.when(F.col("id") % 5 == 0, "none").when(F.col("id") % 5 == 1, "ethics").otherwise("legal").alias("expected"), "category", (F.col("category") != "none").alias("flagged"))


@query(with_("pool") + """, c AS (SELECT CASE WHEN id % 5 = 0 THEN 'none' WHEN id % 5 = 1 THEN 'ethics' ELSE 'legal' END AS e, category AS c FROM pool)
    SELECT count(*) AS cases, round(avg(CAST((e <> 'none') = (c <> 'none') AS INT)), 6) AS accuracy, count(*) FILTER (WHERE e <> 'none' AND c = 'none') AS missed, count(*) FILTER (WHERE e = 'none' AND c <> 'none') AS false_positive, count(*) FILTER (WHERE e <> 'none' AND c <> 'none' AND e <> c) AS wrong_category FROM c""")
def l4_score_labelled(spark, d):
    return labels.score_summary(labels.score_labelled(_cases(spark, d)))


@query(with_("pool") + f"SELECT CAST(t AS DOUBLE) AS threshold, {CONF.format(l="category <> 'none'", s="score >= t")} FROM pool, (VALUES (0.05::DOUBLE), (0.08::DOUBLE), (0.12::DOUBLE), (0.5::DOUBLE)) AS x(t) GROUP BY 1")
def l5_threshold_sweep(spark, d):
    scored = S.scored_documents(spark, d).select("score", (F.col("category") != "none").cast("int").alias("label"))
    return labels.threshold_sweep(scored, [0.05, 0.08, 0.12, 0.5])


# --- streaming rules in batch -------------------------------------------------------------------


@query("""WITH a AS (SELECT user_id AS answer_id, ts AS tried, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'unreachable' ELSE 'failed' END AS o FROM events), g AS (SELECT answer_id, max(tried) FILTER (WHERE o = 'ok') AS ok, max(tried) AS last FROM a GROUP BY 1),
    f AS (SELECT g.answer_id, ok, last, count(*) FILTER (WHERE o = 'failed' AND (ok IS NULL OR tried > ok)) AS failures FROM g JOIN a USING (answer_id) GROUP BY ALL)
    SELECT answer_id, failures, CASE WHEN failures >= 3 THEN 'keep_whole' WHEN ok = last THEN 'done' ELSE 'retry' END AS action, CAST(least(30 * pow(2, failures), 1200) AS BIGINT) AS delay FROM f""")
def st3_retry_ledger(spark, d):
    outcome = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "view", "unreachable").otherwise("failed")
    attempts = S.table(spark, d, "events").select(F.col("user_id").alias("answer_id"), F.col("ts").alias("at"), outcome.alias("outcome"))
    return ingest.retry_ledger(attempts).withColumn("delay", ingest.retry_delay(F.col("failures")))


@query("""WITH a AS (SELECT user_id AS answer_id, ts AS tried, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'unreachable' ELSE 'failed' END AS o FROM events), g AS (SELECT answer_id, max(tried) FILTER (WHERE o = 'ok') AS ok, max(tried) AS last FROM a GROUP BY 1),
    f AS (SELECT g.answer_id, ok, last, count(*) FILTER (WHERE o = 'failed' AND (ok IS NULL OR tried > ok)) AS failures FROM g JOIN a USING (answer_id) GROUP BY ALL)
    SELECT answer_id, failures, CASE WHEN failures >= 3 THEN 'keep_whole' WHEN ok = last THEN 'done' ELSE 'retry' END AS action FROM f""")
def st3_retry_stream(spark, d):
    """The events replayed in several triggers, out of order; the last state of each answer."""
    source, out, checkpoint = (stage_path(spark, f"attempts-{n}") for n in ("in", "out", "checkpoint"))
    outcome = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "view", "unreachable").otherwise("failed")
    S.table(spark, d, "events").select(F.col("user_id").alias("answer_id"), F.col("ts").alias("at"), outcome.alias("outcome")).repartition(4, "at").write.parquet(source)
    attempts = spark.readStream.schema("answer_id long, at timestamp, outcome string").option("maxFilesPerTrigger", 1).parquet(source)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    retries.retry_ledger_stream(attempts).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return retries.latest(spark.read.parquet(out))


# --- the rest of the inventory ------------------------------------------------------------------


@query(with_("answers") + "SELECT id % 1000 AS list_id, count(*) FILTER (WHERE decomposed_at IS NULL) = 0 AS all_decomposed FROM answers GROUP BY 1")
def f8_all_decomposed(spark, d):
    """The check of a thousand id lists in one join."""
    a = S.answers(spark, d)
    return queue.decomposed_lists(a, a.select((F.col("id") % 1000).alias("list_id"), "id"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || '|x' WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE 'x' END AS points,
    CASE WHEN o_orderkey % 3 = 2 THEN 'ok_fallback' ELSE 'ok' END AS status FROM orders""")
def x5_parse_output(spark, d):
    k = F.col("o_orderkey") % 3
    variant = F.when(k == 0, "count").when(k == 1, "annotated").otherwise("v2")
    raw = F.when(k == 0, F.concat(F.lit('{"points": ["'), F.col("o_orderpriority"), F.lit('", "x"]}'))).when(k == 1, F.concat(F.lit('see ["a"] Points: ["'), F.col("o_orderpriority"), F.lit('"]'))).otherwise(F.lit('{"points": ["x"]}'))
    return S.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.parse_output(variant, raw).alias("p")).select("id", F.array_join("p.points", "|").alias("points"), "p.status")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS title FROM orders")
def x6_parse_object(spark, d):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.concat(F.lit('Here: {"title": "'), F.col("o_orderpriority"), F.lit('"} done'))).when(k == 1, F.lit("[1]")).otherwise(F.lit("{broken"))
    return S.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.parse_object(raw, "title string")["title"].alias("title"))


@query("SELECT doc_id, regexp_matches(text, '\\b(users?|respondents?|the\\s+student|the\\s+writer)\\b|^\\s*request\\s+for\\b', 'i') AS narrated FROM documents WHERE text IS NOT NULL")
def x8_narrated(spark, d):
    return S.table(spark, d, "documents").where("text is not null").select("doc_id", X.narrated(F.col("text")).alias("narrated"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, o_orderpriority AS p FROM orders)
    SELECT id AS answer_id, 'ok' || CASE k WHEN 1 THEN '+repair_shape' WHEN 2 THEN '+repair_error' WHEN 3 THEN '' WHEN 6 THEN '+repair_error' WHEN 4 THEN '+repaired' WHEN 5 THEN '+repair_failed' ELSE '+repaired' END AS status,
      CASE k WHEN 0 THEN 'I want ' || p || '|we want ' || p WHEN 4 THEN 'I want ' || p || '|The user wants ' || p WHEN 6 THEN 'I want ' || p || '|The user wants ' || p ELSE 'The user wants ' || p || '|The user wants ' || p END AS points FROM o""")
def x10_accept_repair(spark, d):
    """Two passes: 0 is mended in both, 4 and 6 in the first only, where the second has the wrong shape or an error."""
    k, p = F.col("o_orderkey") % 7, F.col("o_orderpriority")
    o = S.table(spark, d, "orders")
    told, own = F.concat(F.lit("The user wants "), p), F.concat(F.lit("I want "), p)
    both = lambda a, b: F.concat(F.lit('["'), a, F.lit('", "'), b, F.lit('"]'))
    before = o.select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("I want and we want "), p).alias("answer_text"), F.array(told, told).alias("points"), F.lit("ok").alias("status"))
    first = F.when(k.isin(0, 4, 6), both(own, told)).when(k == 1, F.lit('["a"]')).when(k == 5, both(told, told))
    second = F.when(k == 0, both(own, F.concat(F.lit("we want "), p))).when(k == 4, F.lit('["only one"]')).when(k == 5, both(own, own)).when(k == 1, both(own, own))
    passes = [o.where(k != 3).select(F.col("o_orderkey").alias("answer_id"), raw.alias("raw")) for raw in (first, second)]
    return splitting.accept_repair(before, *passes).select("answer_id", "status", F.array_join("points", "|").alias("points"))


@query(with_("topics") + "SELECT id AS topic_id, CASE WHEN id % 3 = 0 THEN 'Title ' || id ELSE canonical_name END AS canonical_name, CASE WHEN id % 3 = 0 THEN 's' END AS canonical_summary FROM topics")
def x15_apply_names(spark, d):
    t = S.topics(spark, d).withColumnRenamed("id", "topic_id")
    k = F.col("topic_id")
    raw = F.when(k % 3 == 0, F.concat(F.lit('{"title": " \\"Title '), k.cast("string"), F.lit('\\" ", "summary": "s"}'))).when(k % 3 == 1, F.lit('{"title": "  "}')).otherwise(F.lit("no answer"))
    return splitting.apply_names(t, t.select("topic_id", raw.alias("raw"))).select("topic_id", "canonical_name", "canonical_summary")


@query(with_("points") + """, u AS (SELECT canonical_topic_id AS topic_id, point_text, row_number() OVER (PARTITION BY canonical_topic_id, point_text ORDER BY assignment_confidence DESC NULLS LAST, id) AS copy, assignment_confidence AS c, id FROM points WHERE canonical_topic_id IS NOT NULL),
    n AS (SELECT topic_id, point_text, row_number() OVER (PARTITION BY topic_id ORDER BY c DESC NULLS LAST, id) AS i FROM u WHERE copy = 1)
    SELECT topic_id, md5('Words: w' || topic_id || chr(10) || string_agg('- ' || point_text, chr(10) ORDER BY i)) AS prompt_md5 FROM n GROUP BY 1""")
def x15_name_requests(spark, d):
    members = S.points(spark, d).where("canonical_topic_id is not null").withColumnRenamed("canonical_topic_id", "topic_id")
    topics = members.select("topic_id").distinct().withColumn("keywords", F.concat(F.lit("w"), F.col("topic_id").cast("string")))
    return splitting.name_requests(topics, members, "Words: {keywords}\n{examples}").select("topic_id", F.md5("prompt").alias("prompt_md5"))


@query(with_("points") + "SELECT id, 384::BIGINT AS dims, true AS unit FROM points WHERE embedded")
def u2_embed(spark, d):
    """Offline encoder (U2), widened to a column's dimensions (U3)."""
    p = S.points(spark, d).where("embedding is not null").select("id", "point_text")
    made = scoring.embed(p, scoring.hashing_encoder(64)).withColumn("embedding", vectors.fit_dims(F.col("embedding"), 384))
    return made.select("id", F.size("embedding").cast("long").alias("dims"), (vectors.norm(F.col("embedding")).between(1 - 1e-5, 1 + 1e-5) | (vectors.norm(F.col("embedding")) == 0)).alias("unit"))


@query("""WITH o AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents)
    SELECT p + 1 AS id, md5(left(text, 5000)) AS text_md5 FROM o WHERE p >= 10 AND p < 110""")
def io2_load_wave(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", F.col("text").alias("raw_text"))
    return io.load_wave(docs, "doc_id", 7, 10, 100, "2024-01-01", "2024-03-01")["answers"].select("id", F.md5("answer_text").alias("text_md5"))


@query(IDENT + "SELECT form_id, t AS old_topic_id FROM tp WHERE (form_id, t) NOT IN (SELECT (form_id, t) FROM ca) AND (form_id, t) NOT IN (SELECT (form_id, t) FROM me)")
def i5_dissolved(spark, d):
    return identity.resolve_identity(*_identity_inputs(spark, d)).dissolved


@query("SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10 AS topic_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, count(*) AS points FROM events GROUP BY 1, 2, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def st4_trend_stream(spark, d):
    """Windows that the watermark has closed; the events are read as a stream."""
    events = S.table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events*.parquet")
    points = stream.select((F.get_json_object("props", "$.k").cast("long") % 10).alias("canonical_topic_id"), F.col("ts").cast("timestamp").alias("created_at"))
    trend = ingest.trend_stream(points)
    out, checkpoint = stage_path(spark, "trend"), stage_path(spark, "trend-checkpoint")
    trend.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(trend.schema).parquet(out).withColumn("period", F.col("period").cast("timestamp_ntz"))


@query(with_("answers") + f"SELECT id AS answer_id, 1::BIGINT AS points FROM answers WHERE {WAITING}")
def st1_ingest_stream(spark, d):
    """Waiting answers, read as a stream and written once."""
    source = stage_path(spark, "answers")
    S.answers(spark, d).write.parquet(source)
    answers = ingest.answer_stream(spark, source, "id long, submission_id long, field_id long, answer_text string, created_at timestamp, decomposed_at timestamp")
    points, marks, checkpoint = (stage_path(spark, f"ingest-{n}") for n in ("points", "marks", "checkpoint"))
    split = lambda batch: batch.select(F.col("id").alias("answer_id"), F.lit(0).alias("point_no"), F.col("answer_text").alias("point_text"), F.lit("short").alias("status"))
    ingest.ingest_stream(answers, split, points, marks, checkpoint).awaitTermination()
    return spark.read.parquet(points).groupBy("answer_id").agg(F.count(F.lit(1)).alias("points"))
