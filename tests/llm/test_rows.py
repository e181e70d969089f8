"""Rows that repeat an id with other texts are judged one by one; no text is lost that nothing justifies."""

import hashlib
import random

import pytest

import corpus_pipeline
from feedback_points.llm.decontaminate import decontaminate
from feedback_points.llm.line_dedup import line_dedup
from feedback_points.llm.near_dedup import near_dedup, near_groups
from feedback_points.llm.quality import quality_filter
from feedback_points.llm.substring_dedup import substring_dedup

rng = random.Random(6)
make = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
A, B, C = make(120), make(90), make(70)
ROWS = [(3, A), (5, A), (5, B), (None, A), (None, C), (7, None), (7, C), (7, C)]


@pytest.fixture(scope="module")
def shared_ids(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, node string, __id int").repartition(3)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_dedup(shared_ids):
    got = near_dedup(shared_ids)
    assert got.columns == shared_ids.columns
    assert texts(got) == sorted([(3, A), (5, B), (None, A), (None, C), (7, None), (7, C)], key=str)
    assert near_dedup(shared_ids.where("false")).count() == 0


def test_decontaminate(spark, shared_ids):
    items = spark.createDataFrame([(1, " ".join(A.split()[20:60])), (2, None)], "item_id long, text string")
    assert texts(decontaminate(shared_ids, items)) == sorted([r for r in ROWS if r[1] != A or r[0] is None], key=str)


def test_line_dedup(spark):
    one, two, three = make(12), make(12), make(12)
    rows = [(3, f"{one}\n{two}"), (5, f"{one}\n{three}"), (5, f"{three}x y\nother {make(9)}"), (None, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = texts(line_dedup(df))
    assert (3, rows[0][1]) in got and (None, one) in got and len(got) == 4
    lost = {t for i, t in got if i == 5}
    assert three in lost  # the copy of the first line goes from the row that has it
    assert any(t.endswith(rows[2][1].split("\n")[1]) for t in lost)


def test_substring_dedup(shared_ids):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(shared_ids).collect())
    kept = lambda i, t, gone=0: (str(i), len((t or "").split()), gone, "" if gone else t or "")
    assert got == sorted([kept(3, A), kept(5, A, 120), kept(5, B), kept(None, A), kept(None, C), kept(7, None), kept(7, C), kept(7, C)])


def test_quality_filter(spark):
    good, bad = "clear useful sentence about the matter", "buy cheap pills now click here"
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    docs = [(i, f"{good if i % 2 else bad} {make(4)}") for i in range(200)] + [(1, f"{bad} {make(4)}"), (0, f"{good} {make(4)}"), (None, f"{bad} {make(4)}")]
    kept = texts(quality_filter(spark.createDataFrame(docs, "doc_id long, text string"), labels))
    assert kept == sorted([(i, t) for i, t in docs if i is None or t.startswith(good)], key=str)


def test_pipeline_keeps_clean_texts_of_shared_ids(spark, tmp_path):
    """A second row under an id that is rejected, a copy or a leak goes through; empty tables give no rows."""
    good, bad = "clear useful sentence about the matter", "buy cheap pills now click here"
    leak = make(40)
    docs = [(i, f"{good if i % 2 else bad} {make(60)}") for i in range(200)]
    docs += [(500, f"{good} {A}"), (501, f"{good} {A}"), (501, f"{good} {B}"), (0, f"{good} {C}"), (502, f"{good} {leak} {make(20)}"), (502, f"{good} {make(50)}"), (None, None)]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, folder).groupBy("doc_id").count().collect()
    count = {r.doc_id: r["count"] for r in rows}
    assert count.get(500, 0) + count.get(501, 0) == 2 and count[0] == 1 and count[502] == 1
    assert all(count.get(i) == 1 for i in range(1, 200, 2)) and not any(i in count for i in range(2, 200, 2))


# --- words that one chain of hashes would not tell apart ---------------------------------------------

X, Y = "moglgcklaaaaabda", "ikgwywcdmbcpvxyw"


def test_near_groups_tell_words_apart(spark):
    df = spark.createDataFrame([(1, X), (2, Y)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_groups(df, k=2).collect()} == {1: 1, 2: 2}


def test_substring_dedup_tells_words_apart(spark):
    side = make(30), make(30)
    df = spark.createDataFrame([(1, f"{side[0]} {X} {side[1]}"), (2, f"{side[0]} {Y} {side[1]}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(df).collect()} == {1: 0, 2: 0}
    assert {hashlib.sha256(r.kept_text.encode()).hexdigest() for r in substring_dedup(df).collect()} == {hashlib.sha256(r.text.encode()).hexdigest() for r in df.collect()}
