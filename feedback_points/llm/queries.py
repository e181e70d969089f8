"""The corpus operators' queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment_digest
from .common import stage_path
from .decontaminate import contaminated
from .exact_dedup import exact_groups
from .line_dedup import line_digest, line_groups
from .near_dedup import near_groups
from .packing import pack
from .pieces import piece_decode, piece_digest, piece_encode
from .pii import find_pii, pii_digest
from .quality import quality_scores
from .substring_dedup import substring_dedup
from .token_store import read_token_shards, token_digest, write_token_shards
from .url_filter import url_filter
from .whitening import whiten

#: The rules that the url query applies.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "token-shards")
    write_token_shards(_table(spark, sf_dir, "documents"), path, vocabulary())
    return token_digest(read_token_shards(spark, path))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"), k=2)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(_table(spark, sf_dir, "documents")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "key string, verdict string"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), vocabulary())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_digest(docs, line_groups(docs))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(_table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    return piece_digest(piece_decode(piece_encode(_table(spark, sf_dir, "documents"), model), model))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_near_dedup": op2_near_dedup,
    "op3_pii": op3_pii,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_alignment": op12_alignment,
    "op13_pieces": op13_pieces,
}

_SPANS = """list_transform(list_transform(range(1, len({k}_v) + 1), lambda i: struct_pack(
  s := coalesce(list_sum(list_transform({k}_g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform({k}_v[1:i - 1], lambda x: length(x))), 0), v := {k}_v[i])),
  lambda p: struct_pack(s := CAST(p.s AS BIGINT), e := CAST(p.s + length(p.v) AS BIGINT), v := p.v, d := regexp_replace(p.v, '[^0-9]', '', 'g')))"""
_SEEK = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}([\x20]?[A-Z0-9]{4}){2,7}([\x20]?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
_TEST = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(p.v, '.'), lambda x: CAST(x AS DOUBLE))) <= 255",
    "card": "length(p.d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(p.d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(p.d)[i] AS INT) ELSE 2 * CAST(reverse(p.d)[i] AS INT) - CASE WHEN CAST(reverse(p.d)[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
    "phone": "length(p.d) BETWEEN 9 AND 15",
    "iban": "list_reduce(list_transform(range(1, length(replace(p.v, ' ', '')) + 1), lambda i: CAST(ascii((replace(p.v, ' ', '')[5:] || replace(p.v, ' ', '')[1:4])[i]) AS BIGINT)), lambda a, c: CASE WHEN c <= 57 THEN a * 10 + c - 48 ELSE a * 100 + c - 55 END % 97, 0::BIGINT) = 1 AND 0.8 + {score} >= 0.75",
    "ssn": "NOT regexp_matches(p.v, '^(000|666|9)|-00-|-0000$') AND 0.5 + {score} >= 0.75",
}
_AROUND = "lower(substr(text, greatest(p.s - 40, 0) + 1, least(p.s, 40)) || ' ' || substr(text, p.e + 1, 40))"
_FOR = {"iban": "iban|bank|konto|account|compte|cuenta", "ssn": "ssn|social security|soc sec"}
for _k, _words in _FOR.items():
    _TEST[_k] = _TEST[_k].replace("{score}", f"CASE WHEN regexp_matches({_AROUND}, '{_words}') THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches({_AROUND}, 'example|sample|beispiel|ejemplo|exemple') THEN 0.3 ELSE 0 END")
_SAID = "list_transform({k}, lambda p: '{k}:' || p.s || ':' || p.e)"
_BASE = ["email", "ip", "card", "phone"]

ORACLE: dict[str, str] = {
    "op2_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        h AS (SELECT doc_id, n, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM s JOIN n USING (doc_id) GROUP BY doc_id, n),
        r AS (SELECT h, min(doc_id) AS node, any_value(n) AS n FROM h GROUP BY h),
        rs AS (SELECT node, n, s FROM r JOIN s ON node = doc_id),
        p AS (SELECT x.node AS a, y.node AS b FROM rs x JOIN rs y ON x.s = y.s AND x.node < y.node AND 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n
              GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        c(node, reach) AS (SELECT node, node FROM r UNION SELECT c.node, e.b FROM c JOIN e ON c.reach = e.a),
        m AS (SELECT node, min(reach) AS component FROM c GROUP BY node)
        SELECT d.doc_id, coalesce(h.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, d.doc_id = coalesce(component, d.doc_id) AS kept
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN r ON h.h = r.h LEFT JOIN m ON m.node = r.node""",
    "op3_pii": (
        "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS (SELECT doc_id, text, "
        + ", ".join(f"regexp_extract_all(text, '{p}') AS {k}_v, string_split_regex(text, '{p}') AS {k}_g" for k, p in _SEEK.items())
        + " FROM t), s AS (SELECT doc_id, "
        + ", ".join(f"list_filter({_SPANS.format(k=k)}, lambda p: {_TEST[k]}) AS {k}" for k in _SEEK)
        + " FROM m), a AS (SELECT *, " + " || ".join(f"coalesce({_SAID.format(k=k)}, [])" for k in _BASE) + " AS base FROM s) SELECT doc_id, "
        + ", ".join(f"CAST(len({k}) AS BIGINT) AS n_{k}" for k in _BASE)
        + f", sha256(array_to_string(base, ',')) AS base_sha256, array_to_string(base || {_SAID.format(k='iban')} || {_SAID.format(k='ssn')}, ',') AS spans FROM a"
    ),
    "op4_url_filter": r"""
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
        r(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        j AS (SELECT page_id, rule_host || rule_path AS rule, verdict FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
        b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM j GROUP BY page_id)
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (page_id)""",
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
        g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p JOIN d USING (doc_id)),
        m AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h),
        r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM g JOIN m USING (h) WHERE doc_id > lo),
        k AS (SELECT doc_id, list(j) AS gone FROM r GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x)), lambda x: w[x]) END, ' '), '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op8_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
        ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
        bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b),
        n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
        SELECT doc_id, item_id, n_shingles, count(*) AS n_found FROM ds JOIN bs USING (s) JOIN n USING (item_id)
        GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles""",
    "op9_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
        g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
}
