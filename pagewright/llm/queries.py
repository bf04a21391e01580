"""The registered queries of the corpus operators: each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (byte_bpe, importance, langid, line_runs, order_minhash, packing, piece_bpe, quality_rules, quality_zstd, simhash_trie,
               token_counts, url_templates, vector_codes)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_zstd.quality_scores(docs, quality_zstd.fit(docs, table(spark, sf_dir, "labels")))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.delete_repeated_runs(docs)


_LEAST = line_runs.MIN_WORDS
ORACLES["op6_line_dedup"] = f"""
WITH numbered AS (
    SELECT doc_id, unnest(range(len(lines))) AS line, unnest(lines) AS content
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
counted AS (SELECT *, len(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+')) AS words FROM numbered),
units AS (
    SELECT *, CAST(sum(words) OVER d AS BIGINT) AS upto, CAST(sum(words) OVER d - words AS BIGINT) AS before,
           sum(words) OVER (PARTITION BY doc_id) AS whole, row_number() OVER d AS u
    FROM counted WHERE words > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY line)),
texts AS (SELECT doc_id, list(content ORDER BY line) AS contents FROM units GROUP BY doc_id),
spans AS (
    SELECT doc_id, u AS s, u - 1 + count(*) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {_LEAST - 1} FOLLOWING) AS e,
           whole - before >= {_LEAST} AS enough FROM units
    UNION ALL
    SELECT doc_id, u + 1 - count(*) OVER (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {_LEAST - 1} PRECEDING AND CURRENT ROW), u,
           upto >= {_LEAST} FROM units),
blocks AS (SELECT DISTINCT doc_id, s, e, contents[s:e] AS content FROM spans JOIN texts USING (doc_id) WHERE enough),
firsts AS (SELECT content, min({{'d': doc_id, 's': s}}) AS place FROM blocks GROUP BY content),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS u
    FROM blocks JOIN firsts USING (content) WHERE {{'d': doc_id, 's': s}} > place),
rest AS (
    SELECT c.doc_id, string_agg(c.content, chr(10) ORDER BY c.line) FILTER (g.u IS NULL) AS rest, count(*) AS n_lines,
           count(g.u) AS n_removed, bool_or(c.words > 0 AND g.u IS NULL) AS has_words
    FROM counted c LEFT JOIN units n ON n.doc_id = c.doc_id AND n.line = c.line LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.u = n.u
    GROUP BY c.doc_id)
SELECT doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN text WHEN has_words THEN rest ELSE '' END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents LEFT JOIN rest USING (doc_id)
"""


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"))


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"))


@query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def _star(level: int) -> str:
    """The tree after generalising one more segment."""
    parent = ", ".join(["host", *[f"s{i}" for i in range(1, level)]])
    own, source = f"s{level}", f"t{level - 1}"
    return f"""
c{level} AS (SELECT {parent}, {own}, sum(n) AS cn FROM {source} GROUP BY ALL),
p{level} AS (SELECT {parent}, count(*) AS children, sum(cn) AS whole FROM c{level} GROUP BY ALL),
t{level} AS (
    SELECT t.* REPLACE (CASE WHEN {own} <> '' AND children > {url_templates.FAN_OUT} AND cn * {url_templates.FAN_OUT} < whole
                             THEN '*' ELSE {own} END AS {own})
    FROM {source} t JOIN c{level} USING ({parent}, {own}) JOIN p{level} USING ({parent}))"""


def _rules_sql(column: str) -> str:
    cases = "".join(
        f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text if column == 'rule' else r.verdict}'"
        for r in sorted(url_templates.RULES, key=lambda r: (-len(r.text), r.text)))
    return f"CASE{cases} END"


ORACLES["op7_url_filter"] = f"""
WITH parts AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages),
ruled AS (
    SELECT *, {_rules_sql('rule')} AS rule, {_rules_sql('verdict')} AS verdict,
           list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '{{n}}', 'g')) AS s
    FROM parts),
urls AS (
    SELECT page_id, host, path, rule, verdict, coalesce(s[1], '') AS raw1, coalesce(s[2], '') AS raw2, coalesce(s[3], '') AS raw3,
           CASE WHEN len(s) > 3 THEN '**' ELSE '' END AS raw4
    FROM ruled),
t0 AS (
    SELECT host, raw1, raw2, raw3, raw4, raw1 AS s1, raw2 AS s2, raw3 AS s3, count(*) AS n,
           sum(CASE WHEN verdict = 'block' THEN 1 ELSE 0 END) AS bad, sum(CASE WHEN verdict IS NOT NULL THEN 1 ELSE 0 END) AS known
    FROM urls GROUP BY host, raw1, raw2, raw3, raw4),
{_star(1)},{_star(2)},{_star(3)},
leaves AS (SELECT host, s1, s2, s3, raw4, sum(bad)::DOUBLE AS bad, sum(known)::DOUBLE AS known FROM t3 GROUP BY ALL),
pooled AS (SELECT host, s1, sum(bad) AS pbad, sum(known) AS pknown FROM leaves GROUP BY ALL),
tested AS (
    SELECT *, CASE WHEN known = 0 THEN true
                   ELSE (bad / known - pbad / pknown) * (bad / known - pbad / pknown)
                        <= {url_templates.CHANCE} * (pbad / pknown) * (1 - pbad / pknown) / known END AS alike
    FROM leaves JOIN pooled USING (host, s1)),
merged AS (SELECT host, s1, sum(bad) AS mb, sum(known) AS mk FROM tested WHERE alike GROUP BY ALL),
hosts AS (SELECT host, sum(bad) AS hb, sum(known) AS hk FROM leaves GROUP BY ALL),
shares AS (
    SELECT host, (hb + {url_templates.HOST_WEIGHT} * (SELECT CASE WHEN sum(hk) > 0 THEN sum(hb) / sum(hk) ELSE 0 END FROM hosts))
                 / (hk + {url_templates.HOST_WEIGHT}) AS share
    FROM hosts),
judged AS (
    SELECT host, s1, s2, s3, raw4,
           (CASE WHEN alike THEN mb ELSE bad END + {url_templates.TEMPLATE_WEIGHT} * share)
           / (CASE WHEN alike THEN mk ELSE known END + {url_templates.TEMPLATE_WEIGHT}) AS purity
    FROM tested LEFT JOIN merged USING (host, s1) JOIN shares USING (host))
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN purity >= {url_templates.REJECT_FROM} THEN 'block' ELSE 'allow' END) AS verdict,
       (CASE WHEN s1 <> '' THEN '/' || s1 ELSE '' END) || (CASE WHEN s2 <> '' THEN '/' || s2 ELSE '' END)
       || (CASE WHEN s3 <> '' THEN '/' || s3 ELSE '' END) || (CASE WHEN raw4 <> '' THEN '/' || raw4 ELSE '' END) AS template,
       purity
FROM urls JOIN t3 USING (host, raw1, raw2, raw3, raw4) JOIN judged USING (host, s1, s2, s3, raw4)
"""


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def _nearest_sql(book: str) -> str:
    """Every part's nearest entry: whole numbers below 2^53, so the doubles are exact."""
    return f"""
    SELECT vec_id, label, p, a, min({{'d': CAST(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - c[i]) * (a[i] - c[i]))) AS BIGINT), 'e': e}}) AS best
    FROM parts JOIN {book} USING (p) GROUP BY ALL"""


def _round_sql(k: int) -> str:
    return f"""
a{k} AS ({_nearest_sql(f'b{k}')}),
m{k} AS (
    SELECT p, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS c
    FROM (SELECT p, best.e AS e, i, sum(a[i])::DOUBLE AS total, count(*) AS n FROM a{k}, range(1, 1025) r(i) WHERE i <= len(a) GROUP BY ALL)
    GROUP BY ALL),
b{k + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, e))"""


ORACLES["op11_vector_codes"] = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * x::DOUBLE) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
    SELECT vec_id, label, p, v[len(v) // {vector_codes.PARTS} * p + 1:len(v) // {vector_codes.PARTS} * (p + 1)] AS a
    FROM kept, range({vector_codes.PARTS}) r(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, a AS c FROM parts QUALIFY e < {vector_codes.ENTRIES}),
{",".join(_round_sql(k) for k in range(vector_codes.ROUNDS))},
last AS ({_nearest_sql(f'b{vector_codes.ROUNDS}')}),
coded AS (
    SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
    FROM last GROUP BY vec_id, label),
digest AS (
    SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{vector_codes.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, digest
"""


@query
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(table(spark, sf_dir, "documents"))


# crc32 by a table of 256 remainders over the bytes of each different feature; 3988292384 is the reversed polynomial.
ORACLES["op12_importance"] = f"""
WITH remainders AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
               lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
texts AS (
    SELECT doc_id, 0 AS side, text FROM documents UNION ALL SELECT NULL, 1, text FROM benchmark),
words AS (
    SELECT doc_id, side, row_number() OVER () AS r,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM texts),
uses AS (
    SELECT doc_id, side, r, f, count(*) AS n
    FROM (SELECT doc_id, side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words)
    GROUP BY ALL),
features AS (
    SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1)),
                              lambda c, b: xor(tab[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % {importance.BUCKETS} AS bucket
    FROM (SELECT DISTINCT f, hex(f) AS h FROM uses), remainders),
placed AS (SELECT doc_id, side, r, bucket, sum(n) AS n FROM uses JOIN features USING (f) GROUP BY ALL),
counts AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t
    FROM placed GROUP BY bucket),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + {importance.BUCKETS})
                                   / ((s + 1) * ((SELECT sum(t) FROM counts) + {importance.BUCKETS})))) AS gain
    FROM counts),
weights AS (SELECT r, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
    SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
           CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{importance.SEED}:' || doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM words LEFT JOIN weights USING (r) WHERE side = 0),
ranked AS (
    SELECT *, n_features >= {2 * importance.MIN_WORDS - 1} AS eligible,
           row_number() OVER (PARTITION BY n_features >= {2 * importance.MIN_WORDS - 1} ORDER BY score DESC, doc_id) AS place,
           count(*) OVER (PARTITION BY n_features >= {2 * importance.MIN_WORDS - 1}) AS many
    FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= {importance.PERCENT} * many // 100 THEN place END AS rank
FROM ranked
"""
