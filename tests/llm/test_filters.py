"""Personal data, url rules, leaks, quality and the pipeline."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedback_points.llm import decontaminate, quality, url_filter
from feedback_points.llm.pii import find_pii, pii_digest, redact

from .conftest import closure, corpus, shingle_set, words_of

TEXTS = [
    "mail bob.x@a-b.co.uk, or a@b.c_d@e.f now", "card 4111 1111 1111 1111, not 4111 1111 1111 1112", "ip 1.2.3.4.5.6.7.8 and 1.2.3.999 and 010.0.0.255",
    "call +49 (30) 1234-567 or +1", "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433", "12-34-5678 9012 345 6 7890123456789012345678", "é漢 x@y.de 漢 +123456789",
    "4111-1111-1111-1111 4 111111111111111", None, "", "@" * 50, "a" * 3000 + "@b.c", "1 " * 500,
]


def base_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_find_pii(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    got = {r.doc_id: [tuple(s)[:3] for s in r.spans] for r in find_pii(df).collect()}
    assert {i: [s for s in v if s[0] not in ("iban", "ssn")] for i, v in got.items()} == {i: base_spans(t) for i, t in enumerate(TEXTS)}
    assert [s for s in got[4] if s[0] == "iban"] == [("iban", 5, 32)]
    assert pii_digest(find_pii(df)).count() == len(TEXTS)
    assert find_pii(df.where("false")).count() == 0


def test_context_raises_the_score_and_redaction(spark):
    df = spark.createDataFrame([(1, "my card 4111 1111 1111 1111"), (2, "xx 4111 1111 1111 1111"), (3, None)], "doc_id long, text string")
    score = {r.doc_id: [s.score for s in r.spans] for r in find_pii(df).collect()}
    assert score[1][0] > score[2][0] and score[3] == []
    assert [r.text for r in redact(df).orderBy("doc_id").collect()] == ["my card <card>", "xx <card>", None]


def test_the_score_decides_on_added_spans(spark, odd):
    """Context words bring a social security number in and keep a sample bank account out; base kinds stay."""
    texts = ["number 123-45-6789 here", "her SSN is 123-45-6789", "ssn 000-45-6789", "for example an ssn like 123-45-6789", "GB82 WEST 1234 5698 7654 32", "a sample: GB82 WEST 1234 5698 7654 32", "a sample bank account: GB82 WEST 1234 5698 7654 32", "sample card 4111 1111 1111 1111", "ssn" + " " * 41 + "123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in find_pii(df).collect()}
    assert got == {0: [], 1: ["ssn"], 2: [], 3: [], 4: ["iban"], 5: [], 6: ["iban"], 7: ["card"], 8: []}
    assert {r.doc_id: [s.kind for s in r.spans] for r in find_pii(df, min_score=0.2).collect()}[3] == ["ssn"]
    assert [r.text for r in redact(df).where("doc_id < 2").orderBy("doc_id").collect()] == [texts[0], "her SSN is <ssn>"]
    assert pii_digest(find_pii(odd)).count() == 8  # null ids and repeated rows are judged one by one


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("b.org/fr/x", "block"), ("b.org/fr/x", "allow")]
URLS = ["http://A.Example.NET/en/x?q#f", "https://example.net/", "http://net", "http://net/", "x.com/de/", None, "", "http://www.example.com/de/1", "http://example.com/fr", "ftp://a.b.org/fr/x1", "http://org/fr/", "://", "http://u.net?x=/en/", "a://b://c.net/x"]


def judge(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host, path = re.match("([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for key, verdict in sorted(RULES, key=lambda r: (-len(r[0]), r[1] != "block")):
        rule_host, rule_path = key.split("/", 1)[0], "/" + key.split("/", 1)[1]
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            best = (key, verdict)
            break
    return (host, path, *(best or (None, "allow")))


@pytest.mark.parametrize("bits, limit", [(12, 4_000_000), (1, 4_000_000), (12, 2)])
def test_url_filter(spark, bits, limit, monkeypatch):
    monkeypatch.setattr(url_filter, "PART_KEYS", limit)
    more = URLS + [f"http://h{i}.example.net/{'en' if i % 2 else 'de'}/{i}" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(more)], "page_id long, url string, key string, rule string")
    rules = spark.createDataFrame(RULES, "key string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, rules, bits_per_key=bits).collect()}
    assert got == {i: judge(u) for i, u in enumerate(more)}
    assert url_filter.url_filter(pages.where("false"), rules).count() == 0
    assert {r.rule for r in url_filter.url_filter(pages, rules.where("false")).collect()} == {None}


def test_url_filter_odd_rows(spark):
    """Null ids and repeated pages are judged one by one."""
    pages = spark.createDataFrame([(None, "http://u.net/"), (1, "http://u.net/"), (1, "http://u.net/"), (2, None)], "page_id long, url string")
    got = url_filter.url_filter(pages, spark.createDataFrame(RULES, "key string, verdict string")).collect()
    assert sorted((r.page_id or -1, r.verdict) for r in got) == [(-1, "block"), (1, "block"), (1, "block"), (2, "allow")]


def test_cascade_is_exact_over_the_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("substring(key, 2) % 7 = 0")
    cascade = url_filter.Cascade.build(listed, universe, bits_per_key=2)
    assert len(cascade.levels) > 2
    wrong = universe.withColumn("got", cascade.contains(F.col("key"))).where("got != (substring(key, 2) % 7 = 0)")
    assert wrong.count() == 0


def leaks_want(rows, items, k=5):
    sets = {i: shingle_set(words_of(t), k) for i, t in rows}
    out = set()
    for j, t in items:
        own = shingle_set(words_of(t), k)
        out |= {(i, j, len(own), len(own & s)) for i, s in sets.items() if own and 100 * len(own & s) >= 80 * len(own)}
    return out


def test_contaminated(spark, docs, rows, empty, monkeypatch):
    texts = [words_of(t) for _, t in rows if t and len(words_of(t)) > 60]
    items = [(j, " ".join(w[7 : 7 + 10 + 4 * j])) for j, w in enumerate(texts[:12])]
    items += [(100, " ".join(texts[0][:30] + ["zz"] * 3)), (101, "one two"), (102, None), (103, ""), (104, " ".join(texts[1][3:33:2]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = leaks_want(rows, items)
    assert want
    for bound in (4_000_000, 100):
        monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_SHINGLES", bound)
        assert {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()} == want
    left = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
    assert left == {i for i, _ in rows} - {w[0] for w in want}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_contaminated_odd_rows(spark, odd):
    """Null ids and repeated rows give their rows; a document of one other word does not hold an item."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    bench = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, thue)], "item_id long, text string")
    more = odd.unionByName(spark.createDataFrame([(50, thue.translate({97: "b", 98: "a"})), (None, "x a b c d e f")], "doc_id long, text string"))
    got = [tuple(r) for r in decontaminate.contaminated(more, bench).collect()]
    assert sorted((d or -1, i or -1, n, m) for d, i, n, m in got) == sorted([(8, 1, 2, 2), (8, 1, 2, 2), (8, -1, 2, 2)] * 2 + [(-1, 1, 2, 2), (-1, 1, 2, 2), (-1, -1, 2, 2)])


def test_sketch_hits_every_containing_set():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 17, 60):
        item = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        probe = decontaminate.sketch([item], 0.8)[0]
        need = -(-len(item) * 80 // 100)
        for _ in range(50):
            assert np.isin(probe, rng.permutation(item)[:need]).any()


def test_quality(spark):
    good, bad = [t for _, t in corpus(3, 200) if t and "\n" not in t], []
    bad = [t.upper().replace(" ", "!! ") for t in good]
    rows = [(i, t) for i, t in enumerate([x for p in zip(good, bad, strict=True) for x in p])] + [(9000, None), (9001, "")]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows if i < 9000] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [r for i, r in got.items() if r.held_out and i < 9000]
    assert len(held) > 20 and np.mean([r.predicted == 1 - r.doc_id % 2 for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[9000].score == got[9001].score
    none = quality.quality_scores(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(docs.where("false"), labels).count() == 0


def test_dual_descent_reaches_the_hinge_optimum():
    """Against projected gradient steps on the dual, with each class's bound."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 30, rng.integers(1, 12))) for _ in range(80)]
    signs = np.where([x.mean() + rng.normal(0, 5) > 15 for x in rows], 1.0, -1.0)
    signs[:50] = np.abs(signs[:50])
    ratio = rng.normal(0, 1, 30)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r], x[i, 30] = ratio[r] / np.sqrt(len(r)), 1.0
    upper = np.where(signs > 0, 1.0, max(1.0, (signs > 0).sum() / (signs < 0).sum()))
    q = (x * signs[:, None]) @ (x * signs[:, None]).T
    a = np.zeros(80)
    for _ in range(60_000):
        a = np.clip(a - (q @ a - 1) / np.linalg.norm(q, 2), 0, upper)
    want = (x * signs[:, None]).T @ a
    w, bias = quality.dual_descent(rows, signs, ratio, tolerance=1e-6, epochs=100_000)
    objective = lambda v: 0.5 * v @ v + (upper * np.maximum(0, 1 - signs * (x @ v))).sum()
    got = np.append(w, bias)
    assert abs(objective(got) - objective(want)) < 1e-3 * objective(want) and np.abs(got - want).max() < 1e-2


def test_held_out_labels_are_not_used(spark):
    rows = [(i, f"w{i % 40} x{i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    held = [r[0] for r in docs.where(quality.held_out()).collect()]
    turned = labels.withColumn("quality", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert held and a == b


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    made = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path / "sf")
    made.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1) for i, _ in rows], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    leak = next(t for _, t in reversed(rows) if t and 30 < len(words_of(t)) < 190)
    spark.createDataFrame([(1, " ".join(words_of(leak)[4:24]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = made
    for name, step in corpus_pipeline.STAGES[1:4]:
        kept = step(spark, kept, folder)
        assert kept.columns == made.columns, name
    # brute force: one of each text, one of each near group, no leaks
    norm = {}
    for i, t in sorted(rows, key=lambda r: (-len(r[1] or ""), r[0])):
        norm.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), i)
    left = {i: dict(rows)[i] for i in norm.values()}
    sets = {i: shingle_set(words_of(t, True), 5) for i, t in left.items()}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    near = closure(list(sets), edges)
    left = {i: t for i, t in left.items() if near[i] == i}
    gone = {w[0] for w in leaks_want(list(left.items()), [(1, " ".join(words_of(leak)[4:24]))])}
    assert gone and {r.doc_id for r in kept.collect()} == set(left) - gone
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
