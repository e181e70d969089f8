"""Splitting answers into points: requests out, responses in, repair, names and synthetic rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_key, grounded, is_thai, narrated, needs_splitting, output_budget, parse_object, parse_points, strip
from ..params import DEFAULTS
from ..session import stage
from ..sources.io import numbered
from .report import spread_examples

#: Kinds of shapes of synthetic rows at most.
MAX_KINDS = 1000


def split_requests(answers: DataFrame, template: str, system: str, short_words: int = DEFAULTS.short_answer_words, window: int = DEFAULTS.context_window) -> DataFrame:
    """``answer_id, prompt, budget, route`` for the answers that need splitting; ``{text}`` stands for the text."""
    text = strip(F.col("answer_text"))
    prompt = F.replace(F.lit(template), F.lit("{text}"), text)
    return answers.where(needs_splitting(text, short_words)).select(
        F.col("id").alias("answer_id"), prompt.alias("prompt"), output_budget(prompt, text, len(system), window).alias("budget"), F.when(is_thai(text), "translate").otherwise("direct").alias("route"),
    )


def apply_split_responses(answers: DataFrame, responses: DataFrame, attempts: DataFrame, max_attempts: int = DEFAULTS.max_attempts, short_words: int = DEFAULTS.short_answer_words) -> DataFrame:
    """``answer_id, points, status``; answers without a response and attempts left are not returned.

    Short answers are one point; an answer whose response holds no points is kept whole, and so is
    one that failed ``max_attempts`` times.
    """
    raw = responses.select("answer_id", F.col("raw").alias("__raw"))
    tried = attempts.select("answer_id", F.col("failures").alias("__failures"))
    text = strip(F.col("answer_text"))
    parsed = parse_points(F.col("__raw"))
    whole = F.array(text)
    short = ~needs_splitting(text, short_words)
    joined = answers.select(F.col("id").alias("answer_id"), "answer_text").join(raw, "answer_id", "left").join(tried, "answer_id", "left")
    status = (
        F.when(short, "short").when(F.col("__raw").isNotNull() & (F.size(parsed["points"]) == 0), "decompose_failed").when(F.col("__raw").isNotNull(), parsed["status"])
        .when(F.coalesce("__failures", F.lit(0)) >= max_attempts, "decompose_gave_up")
    )
    points = F.when(short | (F.col("__raw").isNull()) | (F.size(parsed["points"]) == 0), whole).otherwise(parsed["points"])
    return joined.select("answer_id", points.alias("points"), status.alias("status")).where("status is not null")


def point_rows(split: DataFrame) -> DataFrame:
    """A row per point, numbered from 0."""
    return split.select("answer_id", F.posexplode("points").alias("point_no", "point_text"), "status")


def _narrated_count(points: Column) -> Column:
    return F.size(F.filter(points, narrated))


def accept_repair(before: DataFrame, *passes: DataFrame) -> DataFrame:
    """``answer_id, answer_text, points, status`` once rewrites (``answer_id, raw``) were offered in one or more passes.

    A rewrite (null on an error) is taken only when it has as many points, is grounded in the answer, and has
    fewer narrated ones. Only an answer that still has narrated points after a taken rewrite goes on to the next
    pass, where a failure keeps what was taken. Answers without narrated points, or without an offer, are left alone.
    """
    state = before.select("answer_id", "answer_text", "points", F.col("status").alias("__base"), F.lit("").alias("__mark"), F.lit(True).alias("__open"))
    for after in passes:
        joined = state.join(after.select("answer_id", F.col("raw").alias("__raw"), F.lit(True).alias("__tried")), "answer_id", "left")
        made = parse_points(F.col("__raw"))["points"]
        needs = F.coalesce(F.col("__open") & (_narrated_count(F.col("points")) > 0) & F.col("__tried"), F.lit(False))
        fits = (F.size(made) == F.size("points")) & grounded(made, F.col("answer_text"))
        taken = F.coalesce(needs & F.col("__raw").isNotNull() & fits & (_narrated_count(made) < _narrated_count(F.col("points"))), F.lit(False))
        so_far = F.col("__mark") == "+repaired"
        mark = (
            F.when(~needs, F.col("__mark")).when(F.col("__raw").isNull(), "+repair_error").when(taken | so_far, "+repaired").when(~F.coalesce(fits, F.lit(False)), "+repair_shape").otherwise("+repair_failed")
        )
        state = joined.select("answer_id", "answer_text", F.when(taken, made).otherwise(F.col("points")).alias("points"), "__base", mark.alias("__mark"), (F.col("__open") & (~needs | taken)).alias("__open"))
    return state.select("answer_id", "answer_text", "points", F.concat("__base", "__mark").alias("status"))


def apply_point_repair(points: DataFrame, repaired: DataFrame) -> DataFrame:
    """Stored points with repaired texts; ids stay, and a changed text loses its embedding."""
    new = repaired.select(F.col("id").alias("__id"), F.col("point_text").alias("__text"))
    changed = F.col("__text").isNotNull() & ~F.col("__text").eqNullSafe(F.col("point_text"))
    out = points.join(new, F.col("id") == F.col("__id"), "left").withColumn("embedding", F.when(~F.coalesce(changed, F.lit(False)), F.col("embedding")))
    return out.withColumn("point_text", F.coalesce("__text", "point_text")).select(*points.columns)


def name_requests(topics: DataFrame, members: DataFrame, template: str, k: int = DEFAULTS.naming_examples) -> DataFrame:
    """``topic_id, prompt`` from a topic's keywords and example points; ``{keywords}`` and ``{examples}`` are filled."""
    shown = spread_examples(members, k).groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "point_text"))), lambda s: F.concat(F.lit("- "), s["point_text"])), "\n").alias("__examples"))
    prompt = F.replace(F.replace(F.lit(template), F.lit("{keywords}"), F.coalesce("keywords", F.lit(""))), F.lit("{examples}"), F.coalesce("__examples", F.lit("")))
    return topics.join(shown, "topic_id", "left").select("topic_id", prompt.alias("prompt"))


def apply_names(topics: DataFrame, responses: DataFrame, length: int = DEFAULTS.title_length) -> DataFrame:
    """Topics with the answered title (quotes off, cut) and summary; without one the name they have."""
    made = parse_object(F.col("raw"), "title string, summary string")
    clean = lambda c: F.nullif(F.regexp_replace(strip(c), "^[\"'\\s]+|[\"'\\s]+$", ""), F.lit(""))
    named = responses.select("topic_id", F.left(clean(made["title"]), F.lit(length)).alias("__title"), clean(made["summary"]).alias("__summary"))
    return topics.join(named, "topic_id", "left").withColumn("canonical_name", F.coalesce("__title", "canonical_name")).withColumn("canonical_summary", F.col("__summary")).drop("__title", "__summary")


def _draw(seed: int, what: str) -> Column:
    """An even number from 0 to 1 for each row number ``id``: the first 32 bits of an MD5."""
    return F.conv(F.left(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(what), F.col("id").cast("string"))), F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def _pick(pool: list[str], seed: int, what: str) -> Column:
    return F.get(F.array(*[F.lit(p) for p in pool]), F.floor(_draw(seed, what) * len(pool)).cast("int"))


def _sentences(rows: DataFrame, shapes: DataFrame, slots: dict[str, list[str]], seed: int, which: str) -> DataFrame:
    """``rows`` with a sentence of a drawn kind and shape, its slots filled, as column ``which``, and its kind."""
    kinds = shapes.groupBy("kind").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n")).orderBy("kind").limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of shapes")
    if not kinds:
        raise ValueError("there are no shapes")
    total, below, kind, size = sum(k["weight"] for k in kinds), 0.0, None, None
    for k in kinds[:-1]:
        below += k["weight"]
        hit = _draw(seed, f"kind{which}") < below / total
        kind, size = (F.when(hit, F.lit(k["kind"])), F.when(hit, F.lit(k["n"]))) if kind is None else (kind.when(hit, F.lit(k["kind"])), size.when(hit, F.lit(k["n"])))
    last = kinds[-1]
    kind, size = (F.lit(last["kind"]), F.lit(last["n"])) if kind is None else (kind.otherwise(F.lit(last["kind"])), size.otherwise(F.lit(last["n"])))
    listed = shapes.withColumn("__no", F.row_number().over(Window.partitionBy("kind").orderBy("text")) - 1).select(F.col("kind").alias(f"kind{which}"), "__no", F.col("text").alias(which))
    drawn = rows.withColumn(f"kind{which}", kind).withColumn("__no", F.floor(_draw(seed, f"shape{which}") * size).cast("int"))
    out = drawn.join(listed, [f"kind{which}", "__no"]).drop("__no")
    for name, pool in slots.items():
        out = out.withColumn(which, F.replace(F.col(which), F.lit("{" + name + "}"), _pick(pool, seed, f"{name}{which}")))
    return out


def generate_feedback(
    shapes: DataFrame, slots: dict[str, list[str]], n: int, seed: int = DEFAULTS.seed, violations: list[str] = (), violation_rate: float = 0.06, joiners: list[str] = (), multi_rate: float = 0.25, existing: DataFrame | None = None,
) -> DataFrame:
    """n synthetic rows ``feedback_id, raw_text, kind``, distinct by content key and from the texts of ``existing`` (``raw_text``).

    ``shapes`` has ``kind, weight, text``; kinds are drawn by weight and texts evenly within a kind, then ``{name}`` slots are
    filled from the pools. At ``violation_rate`` a row is one of the ``violations``, which have slots too; at ``multi_rate``
    another is two sentences put together by a joiner (``{a}``, ``{b}``). All draws are hashes of seed and row number, and
    the rows are the first n with new keys: each round draws as many row numbers as are missing, and more, and drops the keys
    held so far. ValueError when 200 draws a row do not give n.
    """
    spark = shapes.sparkSession
    held = stage(existing.select(content_key(F.col("raw_text")).alias("__key")).distinct(), "held-keys") if existing is not None else None
    rounds, have, start = [], 0, 0
    while have < n:
        if start >= 200 * n:
            raise ValueError(f"only {have} of {n} different rows come out of these shapes and slots")
        # as many as are missing by the share of new ones so far, and a tenth more
        more = min(int(1.1 * (n - have) * max(start, 1) / max(have, 1)) + 16, 200 * n - start)
        rows = spark.range(start, start + more)
        two = _sentences(_sentences(rows, shapes, slots, seed, "a"), shapes, slots, seed, "b")
        text, kind = F.col("a"), F.col("kinda").cast("string")
        if joiners:
            joined = F.replace(F.replace(_pick(joiners, seed, "joiner"), F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b"))
            text = F.when(_draw(seed, "multi") < multi_rate, joined).otherwise(text)
        if violations:
            line = _pick(list(violations), seed, "violation")
            for name, pool in slots.items():
                line = F.replace(line, F.lit("{" + name + "}"), _pick(pool, seed, f"{name}v"))
            bad = _draw(seed, "bad") < violation_rate
            text, kind = F.when(bad, line).otherwise(text), F.when(bad, "violation").otherwise(kind)
        made = two.select(F.col("id").alias("feedback_id"), text.alias("raw_text"), kind.alias("kind")).withColumn("__key", content_key(F.col("raw_text")))
        first = made.withColumn("__p", F.row_number().over(Window.partitionBy("__key").orderBy("feedback_id"))).where("__p = 1").drop("__p")
        for earlier in [held, *(r.select("__key") for r in rounds)]:
            first = first if earlier is None else first.join(earlier, "__key", "left_anti")
        rounds.append(stage(first, "synthetic"))
        have, start = have + rounds[-1].count(), start + more
    out = shapes.select(F.lit(0).cast("long").alias("feedback_id"), F.col("text").alias("raw_text"), F.col("kind").cast("string").alias("kind")).where("false")
    for r in rounds[:-1]:
        out = out.unionByName(r.drop("__key"))
    if rounds:
        spare = have - n
        last = rounds[-1].drop("__key")
        out = out.unionByName(last if not spare else numbered(last, "feedback_id").where(F.col("position") < last.count() - spare).drop("position"))
    return out
