"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, packing, pii, quality, secrets, simhash, tokenbin, toxicity, warc
from ._shared import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(table(spark, sf_dir, "documents"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": op2_secrets,
    "op3_langid": op3_langid,
    "op4_packing": op4_packing,
    "op5_tokens": op5_tokens,
    "op6_decontam": op6_decontam,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_pii": op10_pii,
}

_GAMMA = (1 + quality.ACCURACY) / (1 - quality.ACCURACY)
_SHARES = {"symbols_per_char": ("n_symbols", "word_chars"), "dup_lines_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "bangs_per_word": ("n_bangs", "n_words"), "bars_per_word": ("n_bars", "n_words")}
_SHARE = {k: f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)" for k, (a, b) in _SHARES.items()}


def _fences(by: str) -> str:
    """Fences of the sketches merged over everything but ``by``."""
    keys = f"{by}, measure" if by else "measure"
    slack = " ".join(f"WHEN '{k}' THEN {v}" for k, v in quality.SLACK.items())
    value = f"CASE WHEN bucket = -1073741824 THEN 0.0 ELSE pow({_GAMMA}, bucket) * 2 / ({_GAMMA} + 1) END"
    return f"""(SELECT {keys}, greatest(CASE measure {slack} END, q50 + {quality.REACH} * (q75 - q50)) AS fence, docs FROM (
      SELECT {keys}, min(CASE WHEN upto >= 0.5 * n THEN v END) AS q50, min(CASE WHEN upto >= 0.75 * n THEN v END) AS q75, max(n) AS docs FROM (
        SELECT {keys}, {value} AS v, sum(c) OVER (PARTITION BY {keys} ORDER BY bucket) AS upto, sum(c) OVER (PARTITION BY {keys}) AS n FROM (
          SELECT {keys}, bucket, sum(c) AS c FROM sketch GROUP BY {keys}, bucket)) GROUP BY {keys}))"""


_QUALITY_SQL = f"""
WITH w AS (SELECT rowid AS r, doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY r),
m AS (SELECT w.r, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_bangs, length(t) - length(replace(t, '|', '')) AS n_bars FROM w LEFT JOIN c USING (r)),
v AS ({" UNION ALL ".join(f"SELECT r, lang, source, '{k}' AS measure, {x} AS v FROM m" for k, x in _SHARE.items())}),
sketch AS (SELECT lang, source, measure, CASE WHEN v > 0 THEN CAST(ceil(ln(v) / ln({_GAMMA})) AS INT) ELSE -1073741824 END AS bucket, count(*) AS c FROM v GROUP BY ALL),
inside AS (SELECT v.r, bool_and(v.v <= (a.fence + (l.fence - a.fence) * (CAST(l.docs AS DOUBLE) / (l.docs + {quality.PRIOR}))) + (o.fence - (a.fence + (l.fence - a.fence) * (CAST(l.docs AS DOUBLE) / (l.docs + {quality.PRIOR})))) * (CAST(o.docs AS DOUBLE) / (o.docs + {quality.PRIOR}))) AS ok FROM v
    JOIN {_fences("lang, source")} o ON o.measure = v.measure AND o.lang IS NOT DISTINCT FROM v.lang AND o.source IS NOT DISTINCT FROM v.source
    JOIN {_fences("lang")} l ON l.measure = v.measure AND l.lang IS NOT DISTINCT FROM v.lang JOIN {_fences("")} a ON a.measure = v.measure GROUP BY v.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND ok AS kept FROM m JOIN inside USING (r)"""

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f"""

#: The others have no SQL form (learned models, perfect hashes, fingerprints, alignments, tokenizers); tests hold them against brute force.
ORACLES = {"op8_quality": _QUALITY_SQL, "op9_warc": _WARC_SQL}
