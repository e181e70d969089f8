"""Text rules on the edge rows they must get right."""

import pytest
from pyspark.sql import functions as F

from feedback_points.functions import text as X
from feedback_points.operators import splitting


def column(spark, values, made, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(made(F.col("v"))).collect()]


def test_needs_splitting(spark):
    rows = {"one two three four five six": False, "one two three four five six seven": True, "good food, bad wifi": True, "3.5": True, "wifi": False, "It works.": False, "good and bad": True, "": False}
    assert column(spark, list(rows), X.needs_splitting) == list(rows.values())


def test_is_thai(spark):
    assert column(spark, ["good เ food", "good food"], X.is_thai) == [True, False]


def test_narrated(spark):
    rows = {"Request for X": True, "The users wait": True, "user's view": True, "a student waits": False, "the student waits": True, "the  writer": True, "prequest for x": False}
    assert column(spark, list(rows), X.narrated) == list(rows.values())


@pytest.mark.parametrize("raw, points, status", [
    ('["a", " b "]', ["a", "b"], "ok"), ('Sure: ["a"] and ["b"]', ["a"], "ok_fallback"), ("[1,2]", [], "parse_error"), ('["a", 1]', [], "parse_error"), ("[]", [], "ok"),
    ('["  "]', [], "ok"), ('["a"', [], "parse_error"), ('{"a": 1}', [], "parse_error"), ("x [[1]] y", [], "parse_error"), (None, [], "parse_error"),
])
def test_parse_points(spark, raw, points, status):
    got = column(spark, [raw], X.parse_points)[0]
    assert (list(got.points), got.status) == (points, status)


@pytest.mark.parametrize("variant, raw, points, status", [
    ("annotated", 'Note ["x"] Points: ["a"]', ["a"], "ok"), ("count", '{"count": 2, "points": ["a", 1]}', ["a", "1"], "ok"), ("count", 'x {"points": ["a"]} y', ["a"], "ok_fallback"), ("count", '{"n": 1}', [], "parse_error"), ("v2", '["a"]', ["a"], "ok"),
])
def test_parse_output(spark, variant, raw, points, status):
    got = column(spark, [raw], lambda v: X.parse_output(F.lit(variant), v))[0]
    assert (list(got.points), got.status) == (points, status)


def test_grounded(spark):
    source = F.lit("the wifi drops in room 4")
    rows = {("I want lockers",): False, ("wifi lockers",): True, ("it is so",): True, ("the wifi drops", "we want lockers now"): False}
    assert column(spark, [list(k) for k in rows], lambda v: X.grounded(v, source), "array<string>") == list(rows.values())


def test_split_scores(spark):
    got = column(spark, [[], ["alpha beta gamma"], ["alpha"]], lambda v: X.split_scores(F.lit("alpha beta gamma"), F.array(F.lit("x")), v), "array<string>")
    assert (got[0].coverage, got[0].fidelity, got[0].count_exact, got[0].over_split) == (None, None, False, None)
    assert (got[1].coverage, got[1].fidelity, got[1].count_exact) == (1.0, 1.0, True)
    assert got[2].fidelity is None and got[2].coverage == pytest.approx(1 / 3)


def test_names_and_keys(spark):
    assert column(spark, [["a", "b", "c", "d"]], X.topic_name, "array<string>") == ["a, b, c"]
    assert column(spark, ["B a, b!"], X.content_key) == ["a b b"]
    assert column(spark, [" \n\t x \n"], X.strip) == ["x"]
    got = column(spark, ['{"category": " Legal ", "reason": " r "}', '{"category": "odd"}', "no"], X.violation_from_category)
    assert [tuple(g) for g in got] == [(True, "legal", "r"), (None, "none", "unparseable"), (None, "none", "unparseable")]


def test_split_responses(spark):
    answers = spark.createDataFrame([(1, "good food"), (2, "good food, bad wifi"), (3, "a, b"), (4, "c, d"), (5, "e, f")], "id long, answer_text string")
    responses = spark.createDataFrame([(2, '["good food", "bad wifi"]'), (3, "nonsense")], "answer_id long, raw string")
    attempts = spark.createDataFrame([(4, 3), (5, 2)], "answer_id long, failures int")
    got = {r.answer_id: (r.status, list(r.points)) for r in splitting.apply_split_responses(answers, responses, attempts).collect()}
    assert got == {1: ("short", ["good food"]), 2: ("ok", ["good food", "bad wifi"]), 3: ("decompose_failed", ["a, b"]), 4: ("decompose_gave_up", ["c, d"])}


def test_accept_repair(spark):
    text = "I want a quiet room and the wifi drops"
    before = spark.createDataFrame([(i, text, ["The user wants a quiet room", "the wifi drops"], "ok") for i in range(6)] + [(9, text, ["wifi drops"], "ok")], "answer_id long, answer_text string, points array<string>, status string")
    raws = [(0, '["I want a quiet room", "the wifi drops"]'), (1, '["I want a quiet room"]'), (2, '["I want lockers now", "the wifi drops"]'), (3, None), (4, '["The user wants a quiet room", "the wifi drops"]'), (9, '["x"]')]
    got = {r.answer_id: (r.status, list(r.points)[0]) for r in splitting.accept_repair(before, spark.createDataFrame(raws, "answer_id long, raw string")).collect()}
    kept = "The user wants a quiet room"
    assert got == {0: ("ok+repaired", "I want a quiet room"), 1: ("ok+repair_shape", kept), 2: ("ok+repair_shape", kept), 3: ("ok+repair_error", kept), 4: ("ok+repair_failed", kept), 5: ("ok", kept), 9: ("ok", "wifi drops")}


def test_names(spark):
    topics = spark.createDataFrame([(1, "a, b", "a, b"), (2, "c", "c")], "topic_id long, keywords string, canonical_name string")
    members = spark.createDataFrame([(1, 1, "x", 0.9), (2, 1, "y", 0.8), (3, 1, "x", 0.1)], "id long, topic_id long, point_text string, assignment_confidence double")
    prompts = {r.topic_id: r.prompt for r in splitting.name_requests(topics, members, "{keywords}: {examples}").collect()}
    assert prompts == {1: "a, b: - x\n- y", 2: "c: "}
    named = splitting.apply_names(topics, spark.createDataFrame([(1, 'ok {"title": " \\"Quiet rooms\\" ", "summary": "s"}'), (2, '{"title": "  "}')], "topic_id long, raw string"))
    assert {r.topic_id: (r.canonical_name, r.canonical_summary) for r in named.collect()} == {1: ("Quiet rooms", "s"), 2: ("c", None)}
