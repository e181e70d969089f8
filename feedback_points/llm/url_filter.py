"""URL filter by Bloom filter cascades.

A list of url prefixes (host with its subdomains, and the beginning of a path) is encoded over all
candidate keys that the corpus holds: level 1 holds the listed keys, level 2 the unlisted corpus
keys that level 1 lets through, level 3 the listed keys that level 2 lets through, and so on until
a level lets nothing through wrongly. Over the corpus membership is then exact, and judging a url
needs no join. Keys are dealt by hash over as many cascades as it takes to bound each filter; pages
are judged by one after the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Keys of a filter, on average: a filter goes to every task as a literal of some 6 MB at most.
PART_KEYS = 4_000_000
#: Share of unlisted keys that a filter lets through, rounded up.
LET_THROUGH = 0.01
BITS_PER_KEY = 12
HASHES = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def candidates(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Keys that a rule fitting the url could have, longest first (on a tie, the longer host)."""
    labels = F.split(host, "\\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array(*[F.lit(n) for n in path_lengths]) if path_lengths else F.array().cast("array<int>")
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(
        F.filter(starts, lambda n: F.length(path) >= n),
        lambda n: F.struct((-(F.length(h) + n)).alias("a"), (-F.length(h)).alias("b"), F.concat(h, F.substr(path, F.lit(1), n)).alias("key")),
    )))
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


def _bits(key: Column, level: int, size: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(size).cast("long")) for i in range(HASHES)]


def _filter_of(keys: DataFrame, level: int, bits_per_key: int) -> bytes:
    """A Bloom filter as 32-bit words, each with its highest byte first."""
    size = max(64, -(-keys.count() * bits_per_key // 64) * 64)
    bit = keys.select(F.explode(F.array(*_bits(F.col("key"), level, size))).alias("b"))
    words = bit.select(F.floor(F.col("b") / 32).cast("int").alias("w"), F.expr("shiftleft(1L, cast(b % 32 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    out = bytearray(size // 8)
    for w, m in words.collect():  # at most a word for each 32 bits
        out[4 * w : 4 * w + 4] = m.to_bytes(4, "big")
    return bytes(out)


def _holds(key: Column, level: int, words: bytes) -> Column:
    table = F.lit(bytearray(words))  # one object, however often it is used

    def test(b: Column) -> Column:
        word = F.substr(table, F.floor(b / 32).cast("int") * 4 + 1, F.lit(4))
        return F.getbit(F.conv(F.hex(word), 16, 10).cast("long"), (b % 32).cast("int")) == 1

    return reduce(lambda x, y: x & y, [test(b) for b in _bits(key, level, 8 * len(words))])


class Cascade:
    """Exact membership of corpus keys in a list; ``levels`` alternate listed and let-through keys."""

    def __init__(self, levels: list[bytes]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, bits_per_key: int = BITS_PER_KEY, max_levels: int = 32) -> "Cascade":
        """``listed`` and ``universe`` have a string column ``key``."""
        inside = stage(listed.select("key").where("key is not null").distinct(), "listed")
        outside = universe.select("key").join(inside, "key", "left_anti")
        levels: list[bytes] = []
        while len(levels) < max_levels:
            words = _filter_of(inside, len(levels), bits_per_key)
            levels.append(words)
            outside, inside = inside, stage(outside.where(_holds(F.col("key"), len(levels) - 1, words)), "let-through")
            if inside.isEmpty():
                return cls(levels)
        raise ValueError("the cascade does not end; use more bits per key")

    def contains(self, key: Column) -> Column:
        """True when the first level that does not hold the key is an even one (counted from 1)."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            out = F.when(_holds(key, level, self.levels[level]), out).otherwise(F.lit(level % 2 == 1))
        return out


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` (null when none fits), ``verdict``.

    ``rules`` has ``key`` (host and path, such as ``example.com/de/``) and ``verdict`` (allow or
    block); of a key listed with both, block holds. A rule fits its host and all subdomains if the
    url's path starts with the rule's; the longest wins. Null urls and urls without ``://`` have an
    empty host and path. Repeated pages give repeated rows; other columns are ignored.
    """
    listed = stage(rules.where("key is not null").groupBy("key").agg(F.min(F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("v")), "rules")
    lengths = [r[0] for r in listed.select(F.length(F.regexp_extract("key", "^[^/]*(.*)$", 1)).alias("n")).distinct().orderBy("n").collect()]
    host, path = url_parts(F.col(url_col))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    keys = candidates(F.col("host"), F.col("path"), lengths)
    universe = stage(base.select(F.explode(keys).alias("key")).distinct(), "universe")
    parts = max(1, -(-max(listed.count(), int(universe.count() * LET_THROUGH)) // PART_KEYS))
    part_of = lambda key: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts).cast("long"))
    for p in range(parts):
        here = part_of(F.col("key")) == p
        own = stage(universe.where(here), "part-keys") if parts > 1 else universe
        block = Cascade.build(listed.where(here & (F.col("v") == 0)), own, bits_per_key)
        allow = Cascade.build(listed.where(here & (F.col("v") == 1)), own, bits_per_key)
        judged = F.transform(keys, lambda k, i: F.struct(
            i.alias("at"), k.alias("key"), F.when(part_of(k) == p, F.when(block.contains(k), "block").when(allow.contains(k), "allow")).alias("verdict"),
        ))
        won = F.get(F.filter(judged, lambda x: x["verdict"].isNotNull()), F.lit(0))
        base = base.withColumn("__won", won if p == 0 else F.least("__won", won))  # the first candidate is the longest
        if p < parts - 1:
            base = stage(base, "judged")
    return base.select("page_id", "host", "path", F.col("__won.key").alias("rule"), F.coalesce("__won.verdict", F.lit(default)).alias("verdict"))
