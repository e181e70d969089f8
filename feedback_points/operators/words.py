"""Words of topics: frequent words, class-based tf-idf, coherence and diversity."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.text import let, pairs_of, tokens
from ..session import stage

#: Words of two and more letters or digits.
TERM = r"[a-z0-9_]{2,}"
#: Terms that are sent to all tasks at most.
MAX_WANTED = 500_000
#: Counters of terms that a task holds; those of a million take some 300 MB of each worker.
CAPACITY = 200_000
#: Words of the coherence measure.
TOKEN = r"[a-z][a-z'-]{1,}"


def english_stop_words() -> list[str]:
    """Spark's own list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def ngrams(text: Column, stop: list[str] | None = None) -> Column:
    """Words without stop words, and pairs of words that then stand side by side."""
    stop = english_stop_words() if stop is None else stop
    words = tokens(text, TERM)
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    return let(words, lambda w: F.concat(w, pairs_of(w)))


def term_counts(docs: DataFrame, *keys: str, text: str = "text", stop: list[str] | None = None) -> DataFrame:
    return docs.select(*keys, F.explode(ngrams(F.col(text), stop)).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))


def _member_counts(docs: DataFrame, keys: tuple[str, ...], members: str, text: str, stop: list[str]) -> DataFrame:
    """:func:`term_counts` of rows that are in several groups: counted by their sets of groups first."""
    by_set = term_counts(docs, members, text=text, stop=stop).select(F.explode(members).alias("m"), "term", "n")
    return by_set.groupBy(*[F.col(f"m.{k}").alias(k) for k in keys], "term").agg(F.sum("n").alias("n"))


def _terms(words: list[str], stop: frozenset[str]) -> list[str]:
    kept = [w for w in words if w not in stop] if stop else words
    return kept + [f"{a} {b}" for a, b in zip(kept[:-1], kept[1:], strict=True)]


def _rows_of(docs: DataFrame, keys: tuple[str, ...], text: str, members: str | None = None) -> DataFrame:
    """Keys as JSON texts, one of each group that the row is in, and lower-cased text."""
    as_json = lambda s: F.to_json(s, {"ignoreNullFields": "false"})
    groups = F.transform(members, lambda m: as_json(F.struct(*[m[k].alias(k) for k in keys]))) if members else F.array(as_json(F.struct(*keys)))
    return docs.where(F.col(text).isNotNull()).select(groups.alias("keys"), F.lower(F.col(text)).alias("text"))


def _by_key(counts: dict[tuple, Counter]) -> Iterator[tuple[str, list[tuple], Counter]]:
    """Each key, the sets of keys with it that rows have, and the sum of their counters; one sum is held at a time."""
    sets: dict[str, list[tuple]] = {}
    for keys in counts:
        for key in set(keys):
            sets.setdefault(key, []).append(keys)
    for key, own in sets.items():
        total = counts[own[0]]
        if len(own) > 1:
            total = Counter(total)
            for keys in own[1:]:
                total.update(counts[keys])
        yield key, own, total


def _with_keys(df: DataFrame, docs: DataFrame, keys: tuple[str, ...], members: str | None = None) -> DataFrame:
    schema = StructType([docs.schema[members].dataType.elementType[k] if members else docs.schema[k] for k in keys])
    return df.withColumn("__k", F.from_json("key", schema)).select("*", *(F.col("__k")[k].alias(k) for k in keys)).drop("__k", "key") if keys else df.drop("key")


def _tallies(docs: DataFrame, keys: tuple[str, ...], text: str, stop: list[str], keep: int, capacity: int, members: str | None = None) -> DataFrame:
    """Bounded summaries of the terms of each key, one a task (staged).

    ``term, n, gap``: a task's ``keep`` most frequent terms of a key; a row without a term has all terms' number and, as
    ``slack``, more than which no term that the task leaves out occurs there. A task holds ``capacity`` counters; when there
    are more, the lower half goes, and ``slack`` grows by the highest count lost. ``gap`` is by how much
    less a listed term can be undercounted than one that is left out. Rows of the same ``members`` (see
    :func:`class_tfidf`) are counted together, and their counters added up for each key when the task ends.
    """
    stopped = frozenset(stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        error: Counter = Counter()
        total: Counter = Counter()
        held, find = 0, re.compile(TERM).findall
        for batch in batches:
            for key, words in zip(map(tuple, batch.column(0).to_pylist()), map(find, batch.column(1).to_pylist()), strict=True):
                terms = _terms(words, stopped)
                total[key] += len(terms)
                own = counts.setdefault(key, Counter())
                held -= len(own)
                own.update(terms)
                held += len(own)
                if held > capacity:
                    for k, all_of_k in counts.items():
                        ranked = all_of_k.most_common()
                        cut = len(ranked) // 2
                        if cut < len(ranked):
                            error[k] += ranked[cut][1]
                            counts[k] = Counter(dict(ranked[:cut]))
                    held = sum(map(len, counts.values()))
        for key, sets, own in _by_key(counts):
            ranked = own.most_common(keep + 1)
            rest = ranked[keep][1] if len(ranked) > keep else 0
            ranked = ranked[:keep]
            n = len(ranked)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * (n + 1)), pa.array([t for t, _ in ranked] + [None], pa.string()), pa.array([c for _, c in ranked] + [sum(total[g] for g in sets)], pa.int64()), pa.array([rest] * n + [0], pa.int64()), pa.array([0] * n + [rest + sum(error[g] for g in sets)], pa.int64())],
                ["key", "term", "n", "gap", "slack"],
            )

    return stage(_with_keys(_rows_of(docs, keys, text, members).mapInArrow(run, "key string, term string, n long, gap long, slack long"), docs, keys, members), "term-tallies")


def _exact(docs: DataFrame, keys: tuple[str, ...], wanted: DataFrame, text: str, stop: list[str], members: str | None = None) -> DataFrame | None:
    """Counts of the wanted terms (``term``) in each key, one row a task, key and term before the shuffle; None where they are
    too many to be sent to all tasks."""
    wanted = stage(wanted.select("term").distinct(), "wanted-terms")
    if wanted.count() > MAX_WANTED:
        return None
    listed, stopped = frozenset(r[0] for r in wanted.collect()), frozenset(stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        find = re.compile(TERM).findall
        for batch in batches:
            for key, words in zip(map(tuple, batch.column(0).to_pylist()), map(find, batch.column(1).to_pylist()), strict=True):
                counts.setdefault(key, Counter()).update(filter(listed.__contains__, _terms(words, stopped)))
        for key, _, own in _by_key(counts):
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.string()), pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], ["key", "term", "n"])

    parts = _with_keys(_rows_of(docs, keys, text, members).mapInArrow(run, "key string, term string, n long"), docs, keys, members)
    return parts.groupBy(*keys, "term").agg(F.sum("n").alias("n"))


def _bounds(tallies: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``keys, term, low, high`` of the listed terms, and ``keys, total, slack``: no other term of the key occurs more than slack times."""
    sums = stage(tallies.where("term is null").groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("slack").alias("slack")), "term-totals")
    terms = tallies.where("term is not null").groupBy(*keys, "term").agg(F.sum("n").alias("low"), F.sum("gap").alias("gap"))
    high = same_keys(terms, sums, keys).withColumn("high", F.col("low") + F.col("slack") - F.col("gap"))
    return high.select(*keys, "term", "low", "high"), sums


def same_keys(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``a`` with the columns of ``b`` (a row per key); null keys are equal."""
    other = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(other if keys else F.broadcast(other), on).drop(*[f"__{k}" for k in keys])


def _place(df: DataFrame, keys: tuple[str, ...], *order: Column | str) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_words(docs: DataFrame, k: int, *keys: str, text: str = "text", stop: list[str] | None = None, keep: int = 2000, capacity: int = CAPACITY) -> DataFrame:
    """The k most frequent terms of each key; ties in order of the alphabet.

    Tasks send bounded summaries; a second pass counts exactly those terms that can be among the first by the
    summaries' bounds, and no others. Where the bounds do not settle it, summaries of more terms are asked for, as long as a
    task's counters stay within ``capacity``; beyond that all terms are counted by a shuffle.
    """
    stop = english_stop_words() if stop is None else stop
    while True:
        bounds, sums = _bounds(_tallies(docs, keys, text, stop, keep, capacity), keys)
        bounds = stage(bounds, "term-bounds")
        least = _place(bounds, keys, F.desc("low"), "term").where(F.col("place") == k).select(*keys, F.col("low").alias("least"))
        judged = stage(_left_keys(sums, least, keys).withColumn("least", F.coalesce("least", F.lit(0))), "term-least")
        if judged.where("slack > 0 and slack >= least").isEmpty():
            counts = _exact(docs, keys, same_keys(bounds, judged.select(*keys, "least"), keys).where("high >= least"), text, stop)
            counts = term_counts(docs, *keys, text=text, stop=stop) if counts is None else counts
            return _place(counts, keys, F.desc("n"), "term").where(F.col("place") <= k)
        keep *= 16
        if keep > capacity:
            return _place(term_counts(docs, *keys, text=text, stop=stop), keys, F.desc("n"), "term").where(F.col("place") <= k)


def _left_keys(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    other = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(other, on, "left").drop(*[f"__{k}" for k in keys])


def _weight(n: Column, topic_terms: Column, average: Column, term_total: Column) -> Column:
    return F.sqrt(n / topic_terms) * F.log1p(average / term_total)


def class_tfidf(docs: DataFrame, topic: str, k: int = 10, text: str = "text", stop: list[str] | None = None, form: str | None = None, keep: int = 2000, capacity: int = CAPACITY, members: str | None = None) -> DataFrame:
    """The k terms that set each topic apart: square root of the term's share in the topic, times
    log(1 + average terms of a topic / occurrences of the term in all topics), within each form if one is named.

    Terms whose weight cannot be among the first k by the bounds of the tasks' summaries are not counted (see
    :func:`top_words`). A term that no summary lists occurs at most ``slack`` times in its topic; its weight grows with that
    number as long as that is below a quarter of the average, and is bounded by the greatest weight of all beyond.

    With ``members``, an array column of structs with the topic (and form), a row is in each of these topics, and its text is
    read once for all of them.
    """
    stop = english_stop_words() if stop is None else stop
    by = (form,) if form else ()
    keys = (*by, topic)
    while True:
        bounds, sums = _bounds(_tallies(docs, keys, text, stop, keep, capacity, members), keys)
        sums = stage(same_keys(sums.where("total > 0"), sums.where("total > 0").groupBy(*by).agg(F.avg("total").alias("average"), F.sum("slack").alias("all_slack")), by), "topic-terms")
        bounds = stage(bounds, "term-bounds")
        whole = bounds.groupBy(*by, "term").agg(F.sum("low").alias("all_low"), F.sum("high").alias("all_listed"), F.sum(F.lit(0)).alias("none"))
        ranked = same_keys(same_keys(bounds, sums, keys), whole.drop("none"), (*by, "term"))
        low = _weight(F.col("low"), F.col("total"), F.col("average"), F.col("all_listed") + F.col("all_slack"))
        high = _weight(F.col("high"), F.col("total"), F.col("average"), F.col("all_low"))
        ranked = stage(ranked.select(*keys, "term", low.alias("low"), high.alias("high")), "weight-bounds")
        least = _place(ranked, keys, F.desc("low"), "term").where(F.col("place") == k).select(*keys, (F.col("low") - 2e-9).alias("least"))
        most = F.least(F.col("slack").cast("double"), F.col("average") / 4)
        judged = stage(_left_keys(sums, least, keys).withColumn("least", F.coalesce("least", F.lit(0.0))).withColumn("unlisted", F.sqrt(most / F.col("total")) * F.log1p(F.try_divide(F.col("average"), most))), "weight-least")
        settled = judged.where("slack > 0 and (unlisted >= least or slack * 4 > average)").isEmpty()
        keep *= 16
        if settled or keep > capacity:  # a task's counters stay within capacity: beyond it, all terms are counted by a shuffle
            counts = _exact(docs, keys, same_keys(ranked, judged.select(*keys, "least"), keys).where("high >= least"), text, stop, members) if settled else None
            if counts is None:
                counts = _member_counts(docs, keys, members, text, stop) if members else term_counts(docs, *keys, text=text, stop=stop)
            counts = stage(counts, "term-counts")
            scored = same_keys(same_keys(counts, sums, keys), counts.groupBy(*by, "term").agg(F.sum("n").alias("term_total")), (*by, "term"))
            scored = scored.select(*keys, "term", _weight(F.col("n"), F.col("total"), F.col("average"), F.col("term_total")).alias("weight"))
            return _place(scored, keys, F.desc(F.round("weight", 9)), "term").where(F.col("place") <= k)


def keyword_fallback(own: DataFrame, parent: DataFrame, frequent: DataFrame, topic: str) -> DataFrame:
    """A topic's words: its own list, else its parent's, else the frequent ones (``topic, words``)."""
    a, b, c = (df.select(topic, F.col("words").alias(n)) for df, n in ((own, "__a"), (parent, "__b"), (frequent, "__c")))
    some = lambda x: F.when(F.size(x) > 0, F.col(x))
    return a.join(b, topic, "full").join(c, topic, "full").select(topic, F.coalesce(some("__a"), some("__b"), some("__c")).alias("words"))


def npmi_by_topic(topic_words: DataFrame, docs: DataFrame, topic: str, id_col: str = "id", text: str = "text", k: int = 10, form: str | None = None) -> DataFrame:
    """Mean normalised pointwise mutual information of each topic's word pairs, within each form if one is named.

    Words that no document has are dropped; topics with less than two words have no row. Pairs that
    never meet count -1, pairs that stand in every document 1.

    Each listed word has a bitmap of the documents that hold it, per block of 32,768 documents. Only pairs of words of one
    topic are asked for: a block's bitmaps are intersected in one task and their bits counted, so no pair is written per document.
    """
    by = [form] if form else []
    listed = stage(topic_words.where(F.col("place") <= k).select(*by, topic, "term").distinct(), "listed-words")
    vocabulary = listed.select(*by, "term").distinct()
    if listed.count() <= MAX_WANTED:
        vocabulary = F.broadcast(vocabulary)
    numbered = docs.select(*by, F.monotonically_increasing_id().alias("__doc"), F.array_distinct(tokens(F.col(text), TOKEN)).alias("__terms"))
    # written once, so that a document has one number whatever task is run again
    held = stage(numbered.select(*by, "__doc", F.explode("__terms").alias("term")).join(vocabulary, [*by, "term"]), "held-words")
    posting = held.groupBy(*by, F.bitmap_bucket_number("__doc").alias("block"), "term").agg(F.bitmap_construct_agg(F.bitmap_bit_position("__doc")).alias("bits"))
    postings = stage(posting, "postings")
    df = stage(postings.groupBy(*by, "term").agg(F.sum(F.bitmap_count("bits")).alias("df")), "document-counts")

    words = listed.join(df, [*by, "term"]).groupBy(*by, topic).agg(F.array_sort(F.collect_list(F.struct("term", "df"))).alias("w"))  # at most k
    pairs = words.select(*by, topic, F.explode(F.flatten(F.transform("w", lambda a, i: F.transform(F.slice(F.col("w"), i + 2, F.size("w")), lambda b: F.struct(a["term"].alias("term_a"), b["term"].alias("term_b"), a["df"].alias("df_a"), b["df"].alias("df_b")))))).alias("p")).select(*by, topic, "p.*")
    pairs = stage(pairs, "word-pairs")
    met = _met(postings, pairs.select(*by, "term_a", "term_b").distinct(), by)
    n = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"))
    out = pairs.join(met, [*by, "term_a", "term_b"], "left")
    out = out.join(n, by) if by else out.join(F.broadcast(n))  # one row
    p = lambda c: F.col(c) / F.col("docs")
    value = (
        F.when(F.col("both").isNull(), -1.0).when(F.col("both") == F.col("docs"), 1.0)
        .otherwise(F.try_divide(F.log(p("both") / (p("df_a") * p("df_b"))), -F.log(p("both"))))
    )
    return out.groupBy(*by, topic).agg(F.avg(value).alias("npmi"))


def _met(postings: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """``term_a, term_b, both``: documents that hold both words of the pairs that are asked for, where there are any.

    A block's bitmaps go to one task together with the partners of their words, as a sorted group; words of a block are at most
    those listed, so a group is bounded by the topics.
    """
    partners = pairs.groupBy(*by, F.col("term_a").alias("term")).agg(F.collect_list("term_b").alias("partners"))  # at most the words of the topics that share the word
    rows = postings.join(partners, [*by, "term"], "left").select(*by, "block", "term", "bits", "partners")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bits, asked = None, {}, {}

        def counted() -> pa.RecordBatch:
            found = [(key[:-1], a, b, int(np.bitwise_count(bits[a] & bits[b]).sum())) for a, others in asked.items() for b in others if b in bits]
            found = [f for f in found if f[3]]
            columns = [pa.array([f[0][c] for f in found], kinds[c]) for c in range(len(by))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string()), pa.array([f[3] for f in found], pa.int64())], [*by, "term_a", "term_b", "both"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                here, (term, raw, others) = row[: len(by) + 1], row[len(by) + 1 :]
                if here != key and key is not None:
                    yield counted()
                    bits, asked = {}, {}
                key = here
                bits[term] = np.frombuffer(raw, np.uint8)
                if others:
                    asked[term] = others
        if key is not None:
            yield counted()

    kinds = [to_arrow_type(postings.schema[c].dataType) for c in by]
    schema = ", ".join([*(f"`{c}` {postings.schema[c].dataType.simpleString()}" for c in by), "term_a string", "term_b string", "both long"])
    ordered = rows.repartition(*by, "block").sortWithinPartitions(*by, "block")
    return ordered.mapInArrow(run, schema).groupBy(*by, "term_a", "term_b").agg(F.sum("both").alias("both"))


def npmi_coherence(topic_words: DataFrame, docs: DataFrame, topic: str, **options) -> DataFrame:
    return npmi_by_topic(topic_words, docs, topic, **options).agg(F.avg("npmi").alias("npmi"))


def topic_diversity(topic_words: DataFrame, k: int = 10, *by: str) -> DataFrame:
    """Share of distinct words among all topics' first k words."""
    return topic_words.where(F.col("place") <= k).groupBy(*by).agg(F.try_divide(F.count_distinct("term").cast("double"), F.count("term").cast("double")).alias("diversity"))
