import random
import re

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = [f"w{i}" for i in range(400)] + ["Ébène", "naïve", "漢字", "THE", "the"]
CLASHING = ["id", "key", "h", "set", "node", "label", "score", "spans", "start", "group", "text_sha256", "kept"]


def words_of(text, lower=False):
    text = text or ""
    return re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER) if lower else text)


def shingle_set(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def closure(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(seed=1, n=60):
    """Texts with nulls, blanks, copies, near copies, shared passages, personal data and long ones."""
    rng = random.Random(seed)
    make = lambda m: [rng.choice(VOCABULARY) for _ in range(m)]
    passage = make(70)
    base = make(120)
    texts = [None, "", "  \n\t ", "one", "one two", "One  two"]
    while len(texts) < n:
        kind = rng.randrange(7)
        if kind == 0:
            t = base[:]
            for _ in range(rng.randrange(0, 8)):
                t[rng.randrange(len(t))] = rng.choice(VOCABULARY)
            texts.append(" ".join(t))
        elif kind == 1:
            texts.append(" ".join(make(rng.randrange(5, 60)) + passage[rng.randrange(0, 10) :] + make(rng.randrange(0, 30))))
        elif kind == 2 and len(texts) > 8:
            texts.append(rng.choice([t for t in texts if t]).replace(" ", rng.choice([" ", "  ", "\n"])))
        elif kind == 3:
            texts.append("\n".join(" ".join(make(12)) for _ in range(6)))
        elif kind == 4:
            texts.append(" ".join([rng.choice(VOCABULARY)] * rng.randrange(3, 80)))
        else:
            texts.append(" ".join(make(rng.randrange(3, 200))))
    texts.append(" ".join(make(6000)))
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with more columns, whose names the operators use themselves."""
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(i, t, *("x" for _ in CLASHING)) for i, t in rows], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, ties."""
    long_ = " ".join(VOCABULARY[i % 300] for i in range(130))
    return spark.createDataFrame([(None, long_), (5, long_), (5, long_), (3, long_), (None, None), (7, None), (8, "a b c d e f"), (8, "a b c d e f")], "doc_id long, text string")
