"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Positions are code points. The gaps between the matches come from splitting at the same pattern,
so a match's place is the length of what stands before it; no text is scanned by Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Code points before and after a span in which context words count.
NEAR = 40
#: What words for and against add to a score and take from it.
WEIGHT = 0.3
#: Spans of added kinds are reported from this score on.
MIN_SCORE = 0.75
#: Words that speak against any kind.
AGAINST = "example|sample|beispiel|ejemplo|exemple"


@dataclass(frozen=True)
class Kind:
    """A kind of span: ``seek`` is the pattern, ``hint`` a cheap test that texts with a match pass."""

    name: str
    seek: str
    hint: str
    score: float
    context: str
    base: bool = True


#: ``seek`` gives the same spans as the plain pattern beside it, without rescanning long runs.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   a match begins where a run begins or the last match ended
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@", 0.9, "mail|contact|write|schreib|correo"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    Kind("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", ".", 0.6, "ip|host|server|address|login"),
    # [0-9]([\x20-]?[0-9])+ of 13 to 19 digits: a whole run of digits with single blanks or hyphens between
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])", "", 0.7, "card|visa|master|pay|karte|carte|tarjeta"),
    # \+[0-9][\x20().0-9-]+[0-9] of 9 to 15 digits
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile|fax|anruf"),
    # an added kind: international bank account numbers, confirmed mod 97
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?", "", 0.8, "iban|bank|konto|account|compte|cuenta", False),
    # an added kind: United States social security numbers; their form alone is not enough, a word for it must be near
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", 0.5, "ssn|social security|soc sec", False),
)
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn checksum."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(number: Column) -> Column:
    """The remainder that a bank account number's check digits set to 1."""
    plain = F.replace(number, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code <= 57, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def _confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(value) == 1
    if kind == "ssn":
        return ~value.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def _spans(text: Column, kind: Kind) -> Column:
    found = F.struct(F.regexp_extract_all(text, F.lit(kind.seek), F.lit(0)).alias("hits"), F.split(text, kind.seek, -1).alias("gaps"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(m: Column) -> Column:
        def place(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(m["gaps"], i))
            end = start + F.length(F.get(m["hits"], i))
            span = F.struct(start.alias("start"), end.alias("end"), F.get(m["hits"], i).alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(m["hits"]) - 1), start, place)["out"]

    right = F.filter(let(found, placed), lambda s: _confirmed(kind.name, s["value"]))

    def scored(s: Column) -> Column:
        before = F.substr(text, F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR)))
        around = F.concat(before, F.lit(" "), F.substr(text, s["end"] + 1, F.lit(NEAR)))
        said = lambda words: F.when(F.lower(around).rlike(words), WEIGHT).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"], s["end"], s["value"], (F.lit(kind.score) + said(kind.context) - said(AGAINST)).alias("score"))

    likely = text.rlike(kind.seek) if not kind.hint else F.contains(text, F.lit(kind.hint)) & text.rlike(kind.seek)
    return F.when(likely, F.transform(right, scored)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document: id and ``spans``, ordered by kind as listed, then start.

    A span has kind, start, end (exclusive), value and score. Spans that fail their check are
    dropped without another try. Spans of added kinds are reported only where their score, which words
    nearby raise and lower, is at least ``min_score``; base kinds always stay. A null text is an empty one
    and has no spans; repeated rows are judged one by one; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("__text"))
    found = [_spans(F.col("__text"), k) if k.base else F.filter(_spans(F.col("__text"), k), lambda s: s["score"] >= min_score) for k in kinds]
    return out.select("doc_id", F.concat(*found).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with every reported span replaced by ``<kind>``; null texts stay null."""
    for k in kinds:
        docs = docs.withColumn(text_col, _redacted(F.col(text_col), k, min_score))
    return docs


def _redacted(text: Column, kind: Kind, min_score: float) -> Column:
    spans = _spans(F.coalesce(text, F.lit("")), kind)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= min_score)

    def cut(acc: Column, s: Column) -> Column:
        kept = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.concat(acc["out"], kept, F.lit(f"<{kind.name}>")).alias("out"), s["end"].alias("at"))

    done = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), cut)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substr(text, done["at"] + 1))).otherwise(text)


def pii_digest(spans: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    said = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = [k.name for k in kinds if k.base]
    of_kind = lambda name: F.filter("spans", lambda s: s["kind"] == name)
    counts = [F.size(of_kind(n)).cast("long").alias(f"n_{n}") for n in base]
    return spans.select(
        "doc_id", *counts,
        F.sha2(said(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )
