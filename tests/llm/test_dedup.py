"""Exact, near, line and substring dedup against brute force."""

import hashlib
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedback_points.llm import line_dedup, linking, near_dedup
from feedback_points.llm.exact_dedup import exact_dedup, exact_groups
from feedback_points.llm.substring_dedup import SuffixAutomaton, substring_dedup

from .conftest import closure, shingle_set, words_of


def exact_want(rows):
    norm = {i: re.sub("[\x20\x09-\x0d]", "", t or "") for i, t in rows}
    length = {i: len(t or "") for i, t in rows}
    out = {}
    for i, n in norm.items():
        same = [j for j in norm if norm[j] == n]
        keep = min(same, key=lambda j: (-length[j], j))
        out[i] = (keep, len(same), keep == i, hashlib.sha256(n.encode()).hexdigest())
    return out


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_exact_groups(docs, rows, ranges):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs, ranges=ranges).collect()}
    assert got == exact_want(rows)


def test_exact_hot_group(spark):
    rows = [(i, "same text " * 20 if i % 3 else f"same text {i}") for i in range(400)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), ranges=30).collect()}
    assert got == exact_want(rows)


def test_exact_odd_rows(odd, empty):
    got = exact_groups(odd).collect()
    assert len(got) == 8 and sorted((r.doc_id, r.keep_id) for r in got if r.kept) == [(3, 3), (7, 7), (8, 8)]
    assert exact_groups(empty).count() == 0 and exact_dedup(empty).count() == 0


@pytest.mark.parametrize("ranges", [1, 7])
def test_exact_dedup_judges_rows(spark, ranges):
    """Shared, repeated and null ids: one row of each text stays, and no other text is lost."""
    rows = [(3, "same text"), (4, "same  text "), (3, "unique under a shared id"), (1, "dup"), (1, "dup"), (None, "nil"), (None, "n il"), (None, None), (9, ""), (None, "other")]
    df = spark.createDataFrame([(i, t, f"c{n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, row string")
    got = exact_dedup(df, ranges=ranges)
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in got.collect()) == [(-1, "n il"), (-1, "other"), (1, "dup"), (3, "unique under a shared id"), (4, "same  text "), (9, "")]
    groups = exact_groups(df, ranges=ranges).collect()
    assert len(groups) == 10 and sum(r.kept for r in groups) == 6


def test_exact_dedup_keeps_columns(docs, rows):
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in exact_want(rows).items() if w[2])


def near_want(rows, k):
    sets = {i: shingle_set(words_of(t, True), k) for i, t in rows}
    some = [i for i in sets if sets[i]]
    edges = [(a, b) for a in some for b in some if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = closure(list(sets), edges)
    return {i: (len(sets[i]), component[i], component[i] == i) for i in sets}


@pytest.mark.parametrize("k, hot", [(2, 64), (5, 64), (2, 2)])
def test_near_groups(docs, rows, k, hot, monkeypatch):
    monkeypatch.setattr(linking, "HOT", hot)
    monkeypatch.setattr(linking, "BLOCK", 3 if hot == 2 else 1024)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs, k=k).collect()}
    assert got == near_want(rows, k)


def test_chunk_keys_guarantee():
    rng = np.random.default_rng(0)
    for far in (0, 5, 12, 23):
        a = rng.integers(0, 1 << 16, (50, 72)).astype(np.uint16)
        b = a.copy()
        for r in range(50):
            b[r, rng.permutation(72)[:far]] ^= 1
        for x, y in zip(near_dedup.chunk_keys(a), near_dedup.chunk_keys(b), strict=True):
            assert set(x) & set(y)


def test_near_odd_rows(odd, empty):
    got = near_dedup.near_groups(odd, k=5).collect()
    assert len(got) == 8
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (5, 3, False), (3, 3, True), (7, 7, True), (8, 8, True)}
    assert near_dedup.near_groups(empty).count() == 0
    assert sorted(r.doc_id or -1 for r in near_dedup.near_dedup(odd).collect()) == [-1, -1, 3, 7, 8, 8]


def edit(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def line_places(rows):
    places = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            norm = re.sub("[\x20\x09-\x0d]+", " ", line.lower()).strip(" ")
            if norm:
                places.setdefault(norm, []).append((d, i))
    return places


def similar(x, y, share=0.2):
    allowed = int(share * max(len(x), len(y)) + 1e-9)
    if abs(len(x) - len(y)) > allowed:
        return False
    a, b = Counter(x), Counter(y)  # an edit changes two counts at most
    return sum(((a - b) | (b - a)).values()) <= 2 * allowed and edit(x, y) <= allowed


def check_lines(got, places, least):
    """Groups join only what edit distances join, and hold most of the pairs that they allow."""
    lines = list(places)
    true = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if similar(lines[a], lines[b])]
    most = closure(range(len(lines)), true)
    group = {}
    for norm, own in places.items():
        sizes = {got[p][0] for p in own}
        assert len(sizes) == 1 and sizes.pop() >= len(own)
    kept = [p for p, (_, k) in got.items() if k]
    assert set(got) == {p for own in places.values() for p in own} and len(kept) >= len(set(most.values()))
    for n, norm in enumerate(lines):
        first = min(p for m in range(len(lines)) if most[m] == most[n] for p in places[lines[m]])
        group[n] = (most[n], first)
        assert got[first][1]  # the first of a whole true group stays
    joined = sum(got[places[lines[a]][0]][0] > len(places[lines[a]]) and got[places[lines[b]][0]][0] > len(places[lines[b]]) for a, b in true)
    assert joined >= least * len(true)
    return len(true)


def edited_lines(seed=8):
    """Lines of several lengths, each with a character or a word changed, moved or left out."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9)))
    out = []
    for size in (6, 8, 10, 15, 25, 60):
        for k in range(12):
            base = [word() for _ in range(size)]
            text = " ".join(base)
            at = int(rng.integers(1, len(text) - 1))
            other = base[:]
            other[int(rng.integers(size))] = word()
            out += [text, [text[:at] + "q" + text[at + 1 :], " ".join(other), " ".join(base[1:]), text + "."][k % 4]]
    return out


def test_line_groups(spark, docs, rows):
    tricky = [(1000 + i, t) for i, t in enumerate(["alpha beta gamma delta epsilon zeta eta theta iota kappa\n\nx", "Alpha  beta gamma delta epsilon zeta eta theta iota kappa", "alpha beta gamma delta epsilon zeta eta theta iota kappas", "x\nx", "ab", "abc", "abcd\n\u2028 \x85"])]
    tricky += [(2000 + i, t) for i, t in enumerate(edited_lines())]
    both = docs.where("length(text) < 20000 or text is null").select("doc_id", "text", F.lit(1).alias("h"), F.lit(2).alias("keys")).unionByName(spark.createDataFrame(tricky, "doc_id long, text string").withColumns({"h": F.lit(1), "keys": F.lit(2)}))
    got = {(r.doc_id, r.line_no): (r.group_size, r.kept) for r in line_dedup.line_groups(both).collect()}
    places = line_places([r for r in rows if len(r[1] or "") < 20000] + tricky)
    assert check_lines(got, places, 0.9) > 70
    assert [got[1000, 0], got[1001, 0], got[1002, 0], got[1003, 0], got[1003, 1]] == [(3, True), (3, False), (3, False), (3, False), (3, False)]


@pytest.mark.parametrize("hot", [64, 2])
def test_line_groups_in_blocks(spark, hot, monkeypatch):
    """Large buckets give the same groups as small ones."""
    monkeypatch.setattr(linking, "HOT", hot)
    monkeypatch.setattr(linking, "BLOCK", 4)
    base = [f"word{i}" for i in range(20)]
    rows = [(i, " ".join(base[:9] + [f"tail{i}"] * (i % 3) + base[9:])) for i in range(30)] + [(100 + i, " ".join(base[::-1] + [f"end{i}"])) for i in range(10)]
    got = {(r.doc_id, r.line_no): (r.group_size, r.kept) for r in line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 0): (30 if i < 100 else 10, i in (0, 100)) for i, _ in rows}


@pytest.mark.parametrize("n", [100, 300])
def test_lines_of_the_same_words_write_few_pairs(spark, n, monkeypatch):
    """Orders of the same words share features, but not neighbours: no pair of each two of them is written."""
    rng = np.random.default_rng(1)
    base = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(14)]
    rows = [(i, " ".join(rng.permutation(base))) for i in range(n)]
    written = []

    def count(df, name, real=linking.stage):
        out = real(df, name)
        if name.endswith(("-hubs", "-across", "-links", "-more", "-blocks")):
            written.append(out.count())
        return out

    monkeypatch.setattr(linking, "stage", count)
    assert line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").count() >= n - 2
    assert sum(written) <= 3 * n


def test_line_odd_rows(odd, empty):
    got = line_dedup.line_groups(odd).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (8, 2, True), (8, 2, True)]
    assert line_dedup.line_groups(empty).count() == 0


def test_line_ids_stay(spark, docs, monkeypatch):
    """A line keeps its id however the files are put into scan partitions (as when executors come or go)."""
    seen = []

    class Enough(Exception):
        pass

    def link(members, *args, **options):
        for parts in (1, 8):
            spark.conf.set("spark.sql.files.minPartitionNum", parts)
            seen.append({(r.key, r.id) for r in members.select("key", "id").distinct().collect()})
        raise Enough

    monkeypatch.setattr(line_dedup, "link_components", link)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        with pytest.raises(Enough):
            line_dedup.line_groups(docs)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0] == seen[1]


def test_sim_hash_of_long_lines(spark):
    import xxhash

    def sim(line):
        words = line.split(" ")
        both = [*zip(words, words[1:], strict=False), (words[-1],)]
        seen = set()
        for pair in both:
            h = 42
            for w in pair:
                h = xxhash.xxh64_intdigest(w.encode(), seed=h)
            seen.add(h)
        return sum(1 << b for b in range(63) if 2 * sum(h >> b & 1 for h in seen) > len(seen))

    lines = [" ".join(f"w{i}" for i in range(n)) for n in (1, 2, 255, 256, 3000)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r.line: r.s for r in df.select("line", line_dedup.sim_hash(F.col("line")).alias("s")).collect()}
    assert got == {x: sim(x) for x in lines}


def test_block_keys_of_changed_words(spark):
    """A word that is replaced leaves some blocks as they are, in lines of any length."""
    rng = np.random.default_rng(3)
    rows = []
    for n in (3, 7, 13, 14, 16, 18, 19, 40, 300, 4000):
        for _ in range(20):
            words = [f"w{x}" for x in rng.integers(0, 10**6, n)]
            other = words[:]
            other[int(rng.integers(n))] = "zzz"
            rows.append((n, " ".join(words), " ".join(other)))
    df = spark.createDataFrame(rows, "n int, a string, b string").withColumns({"ka": line_dedup.block_keys(F.col("a")), "kb": line_dedup.block_keys(F.col("b"))})
    got = {r.n: (r.met, r.most) for r in df.groupBy("n").agg(F.avg(F.arrays_overlap("ka", "kb").cast("double")).alias("met"), F.max(F.size("ka")).alias("most")).collect()}
    assert all(met >= 0.9 for n, (met, _) in got.items() if n > 6) and all(most <= 4 * line_dedup.BLOCKS for _, most in got.values())


def test_line_dedup_text(spark, empty):
    df = spark.createDataFrame([(2, "a b\n\nc"), (1, "A  b\nd"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()} == {1: "A  b\nd", 2: "\nc", 3: None}
    assert line_dedup.line_groups(empty).count() == 0
    digest = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in line_dedup.line_digest(df, line_dedup.line_groups(df)).collect()}
    assert digest == {1: (2, 0, ""), 2: (2, 1, "0"), 3: (0, 0, "")}


def substring_want(rows, window):
    first = {}
    listed = {i: words_of(t) for i, t in rows}
    for i in sorted(listed):
        for p in range(len(listed[i]) - window + 1):
            first.setdefault(tuple(listed[i][p : p + window]), i)
    out = {}
    for i, w in listed.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("window, gram", [(50, 10), (12, 5), (10, 10)])
def test_substring_dedup(docs, rows, window, gram):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs, window=window, gram=gram).collect()}
    assert got == substring_want(rows, window)


@pytest.mark.parametrize("window, gram, frequent", [(50, 10, 64), (50, 10, 3), (12, 5, 3)])
def test_substring_hot_passage(spark, docs, rows, window, gram, frequent, monkeypatch):
    """A passage in most documents, each time between other words, doesn't meet in one automaton."""
    module = sys.modules["feedback_points.llm.substring_dedup"]
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(60))
    more = [(2000 + i, " ".join([*(f"a{x}" for x in rng.integers(0, 900, 45)), passage, *(f"b{x}" for x in rng.integers(0, 900, 45))])) for i in range(60)]
    more += [(3000 + i, "again " * (60 + i)) for i in range(5)]
    # two words in an order that sums of powers do not tell from its complement, and one changed word
    odd = [["aa", "bb"][bin(i).count("1") % 2] for i in range(2048)]
    more += [(3100, " ".join(odd)), (3101, " ".join(["bb" if w == "aa" else "aa" for w in odd]))]
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    around = [f"z{i}" for i in range(60)]
    more += [(3200, " ".join([*around[:30], thue, *around[30:]])), (3201, " ".join([*around[:30], thue.translate({97: "b", 98: "a"}), *around[30:]]))]
    most = []

    def match(sent, n, real=module._match):
        most.append(sent.groupBy("key").agg(F.sum(F.length("words") / 8).alias("n"), F.count(F.lit(1)).alias("rows")).where("rows > 1").agg(F.max("n")).first()[0] or 0)
        return real(sent, n)

    monkeypatch.setattr(module, "_match", match)
    monkeypatch.setattr(module, "HOT_WORDS", 1000, raising=False)
    monkeypatch.setattr(module, "FREQUENT", frequent)
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(both, window=window, gram=gram).collect()}
    assert got == substring_want(rows + more, window)
    assert most[0] <= 1000


def test_substring_odd_rows(odd, empty):
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup(odd).collect())
    assert got == [(-1, 0, 0), (-1, 130, 0), (3, 130, 0), (5, 130, 130), (5, 130, 130), (7, 0, 0), (8, 6, 0), (8, 6, 0)]
    assert substring_dedup(empty).count() == 0


def test_suffix_automaton():
    rng = np.random.default_rng(2)
    for _ in range(30):
        held = [rng.integers(0, 3, rng.integers(1, 25)).tolist() for _ in range(3)]
        text = rng.integers(0, 3, 40).tolist()
        automaton = SuffixAutomaton()
        for s in held:
            automaton.add(s)
        inside = {tuple(s[i:j]) for s in held for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        covered = {p for i in range(40) for j in range(i + 4, 41) if tuple(text[i:j]) in inside for p in range(i, j)}
        assert {p for a, b in automaton.spans(text, 4) for p in range(a, b)} == covered
