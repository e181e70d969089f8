"""Text rules on columns; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULTS

# Words that carry no content when a point is checked against its source.
FUNCTION_WORDS = (
    "a an the i we my our me us they them their it its is are was were be been am "
    "do does did have has had will would can could should of to in on at for with "
    "and or but so that this these those there here as by from not no"
).split()
# Stop words of the split-quality measures.
STOP_WORDS = (
    "a an the and or but if then than that this these those is are was were be been being am "
    "do does did doing have has had having i me my we our you your he she it they them his her "
    "its their to of in on at for with as by from about into over after before between out up "
    "down off not no so very can will just should now more most some such only own same too "
    "s t don"
).split()
# Pronouns that a point should not lean on.
PRONOUNS = "it this that they them she he her his these those".split()
# Patterns of the text rules.
CLAUSE_BREAK = r"(?i)[,;:]|\s(?:and|but|also|however|although|though|while|plus)\s|[.!?]\s*\S"
NARRATED = r"(?i)\b(?:users?|respondents?|the\s+student|the\s+writer)\b|^\s*request\s+for\b"
THAI = "[\\u0E00-\\u0E7F]"
WORD = "[a-z0-9']+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, even where a lambda refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def needs_splitting(text: Column, short_words: int = DEFAULTS.short_answer_words) -> Column:
    """Whether an answer is long (more than ``short_words`` words between blanks) or structured enough to hold two points."""
    return text.rlike(rf"^\s*+(?:\S++\s++){{{short_words}}}+\S") | text.rlike(CLAUSE_BREAK)


def is_thai(text: Column) -> Column:
    return text.rlike(THAI)


def output_budget(prompt: Column, text: Column, system_length: int, window: int = DEFAULTS.context_window) -> Column:
    """Tokens a splitting request may answer with."""
    third = lambda x: F.floor(x / 3)
    wanted = F.greatest(F.lit(512), 2 * (third(F.length(text)) + 1))
    room = window - third(F.length(prompt) + system_length)
    return F.greatest(F.lit(256), F.least(wanted, room)).cast("int")


def _string_list(raw: Column) -> Column:
    """The trimmed, non-blank strings of a JSON list that holds strings only; else null."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    items = F.from_json(raw, "array<string>")
    clean = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.when(kind == "ARRAY<STRING>", clean).when(kind == "ARRAY<VOID>", F.array().cast("array<string>"))


def parse_points(raw: Column) -> Column:
    """Struct of ``points`` and ``status`` (ok, ok_fallback, parse_error) from a model's answer.

    The whole text is tried first, then its first ``[...]``. A list with anything but strings is
    refused; a list of blanks is an empty, valid one.
    """
    whole = _string_list(strip(raw))
    inner = _string_list(F.nullif(F.regexp_extract(raw, r"(?s)\[.*?\]", 0), F.lit("")))
    none = F.array().cast("array<string>")
    return (
        F.when(whole.isNotNull(), F.struct(whole.alias("points"), F.lit("ok").alias("status")))
        .when(inner.isNotNull(), F.struct(inner.alias("points"), F.lit("ok_fallback").alias("status")))
        .otherwise(F.struct(none.alias("points"), F.lit("parse_error").alias("status")))
    )


def _object_text(raw: Column, pattern: str) -> Column:
    whole = strip(raw)
    is_object = lambda x: F.coalesce(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), F.lit(False))
    inner = F.nullif(F.regexp_extract(raw, pattern, 0), F.lit(""))
    return F.when(is_object(whole), whole).when(is_object(inner), inner)


def parse_object(raw: Column, fields: str) -> Column:
    """The JSON object of a model's answer as a struct of ``fields``, or null; first ``{...}`` as a fallback."""
    return F.from_json(_object_text(raw, r"(?s)\{.*?\}"), fields)


def parse_output(variant: Column, raw: Column) -> Column:
    """:func:`parse_points` for each way a prompt variant answers."""
    after = F.when(raw.contains("Points:"), F.regexp_replace(raw, r"(?s)^.*?Points:", "")).otherwise(raw)
    text = _object_text(raw, r"(?s)\{.*\}")
    listed = F.from_json(text, "points array<string>")["points"]
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), "$.points", "variant"))
    items = F.filter(F.transform(listed, strip), lambda x: x != "")
    none = F.array().cast("array<string>")
    counted = F.when(
        kind.startswith("ARRAY"),
        F.struct(F.coalesce(items, none).alias("points"), F.when(text == strip(raw), "ok").otherwise("ok_fallback").alias("status")),
    ).otherwise(F.struct(none.alias("points"), F.lit("parse_error").alias("status")))
    return F.when(variant == "count", counted).when(variant == "annotated", parse_points(after)).otherwise(parse_points(raw))


def narrated(point: Column) -> Column:
    """Whether a point speaks about its writer from outside."""
    return point.rlike(NARRATED)


def grounded(points: Column, text: Column) -> Column:
    """Whether of every point at least half of the content words stand in the source text."""
    def fits(point: Column, source: Column) -> Column:
        def enough(content: Column) -> Column:
            return 2 * F.size(F.filter(content, lambda w: F.array_contains(source, w))) >= F.size(content)

        return let(F.filter(tokens(point), lambda w: ~w.isin(FUNCTION_WORDS)), enough)

    return let(F.array_distinct(tokens(text)), lambda source: F.forall(points, lambda p: fits(p, source)))


def _content(words: Column) -> Column:
    return F.filter(F.array_distinct(words), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def pairs_of(words: Column) -> Column:
    """Neighbouring words, joined by a blank."""

    def pairs(w: Column) -> Column:
        return F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))

    return let(words, pairs)


def split_scores(raw: Column, gold: Column, pred: Column) -> Column:
    """Struct of coverage, fidelity, pronoun_rate, count_exact, over_split, under_split.

    An empty prediction has null measures and no exact count; so has a measure without words.
    """
    share = lambda part, whole: F.try_divide(F.size(F.array_intersect(part, whole)).cast("double"), F.size(whole).cast("double"))
    some = F.size(pred) > 0

    def measures(source: Column, said: Column) -> Column:
        return F.struct(
            let(_content(source), lambda of: share(said, of)).alias("coverage"), let(F.array_distinct(pairs_of(said)), lambda of: share(pairs_of(source), of)).alias("fidelity"),
            (F.size(F.filter(said, lambda w: w.isin(PRONOUNS))) / F.greatest(F.size(said), F.lit(1))).alias("pronoun_rate"),
        )

    measured = let(tokens(raw), lambda source: let(tokens(F.array_join(pred, " ")), lambda said: measures(source, said)))
    return let(F.when(some, measured), lambda m: F.struct(
        m["coverage"].alias("coverage"), m["fidelity"].alias("fidelity"), m["pronoun_rate"].alias("pronoun_rate"),
        (some & (F.size(pred) == F.size(gold))).alias("count_exact"), F.when(some, F.size(pred) > F.size(gold)).alias("over_split"), F.when(some, F.size(pred) < F.size(gold)).alias("under_split"),
    ))


def content_key(text: Column) -> Column:
    """All words in order of the alphabet, repeats included: equal for reordered texts."""
    return F.array_join(F.sort_array(tokens(text, "[a-z0-9]+")), " ")


def topic_name(words: Column, length: int = DEFAULTS.title_length) -> Column:
    return F.left(F.array_join(F.slice(words, 1, 3), ", "), F.lit(length))


def topic_keywords(words: Column) -> Column:
    return F.array_join(F.slice(words, 1, 10), ", ")


def violation_from_category(raw: Column) -> Column:
    """Struct of is_violation, category, reason from a model's answer; (null, none, unparseable) when it is none."""
    made = parse_object(raw, "category string, reason string")
    category = F.lower(strip(F.coalesce(made["category"], F.lit(""))))
    known = F.coalesce(category.isin("legal", "ethics", "moral", "none"), F.lit(False))
    return F.struct(
        F.when(known, category != "none").alias("is_violation"),
        F.when(known, category).otherwise("none").alias("category"),
        F.when(known, F.left(strip(F.coalesce(made["reason"], F.lit(""))), F.lit(120))).otherwise("unparseable").alias("reason"),
    )


def md5_order(seed: int, *ids: str | Column) -> Column:
    """A reproducible random order: md5 of seed and ids."""
    cols = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in ids]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))
