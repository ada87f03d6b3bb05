"""Queries that apply each operator to its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_id, license_scan, line_dedup, lm_scoring, media, packing, suffix_dedup, url_filter
from .base import table

#: The rules of the URL query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.score(docs, table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths are made of source and id; every 512th document is the licence file of a
    directory, every 32nd that of a directory below."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    top, sub = F.floor(F.col("doc_id") / 512).cast("string"), F.floor(F.col("doc_id") / 32).cast("string")
    path = (
        F.when(F.col("doc_id") % 512 == 0, F.concat_ws("/", "source", top, F.lit("LICENSE")))
        .when(F.col("doc_id") % 32 == 0, F.concat_ws("/", "source", top, sub, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", "source", top, sub, F.col("doc_id").cast("string")))
    )
    return license_scan.scan(docs, path, is_licence_file=path.endswith("/LICENSE"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = media.store_texts(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    read = media.read_media(stored, payload=True)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_s", "n_frames", "seek_offsets")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op2_license_scans, op3_ngram_jaccard_join, op4_media_columns, op5_packing, op6_suffix_array_dedup, op7_line_dedup, op8_language_id, op9_url_filters, op10_benchmark_decontamination)
}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_TEMPLATES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(license_scan.templates()))
_TERMS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x NOT IN (''" + "".join(f", '{w}'" for w in license_scan.STOP) + "))"


ORACLE_SQL: dict[str, str] = {
    "op2_license_scans": f"""
WITH tpl(tid, license, notice) AS (VALUES {_TEMPLATES}
), tt AS (SELECT tid, license, term, count(*) AS tf FROM (SELECT tid, license, unnest({_TERMS.format('notice')}) AS term FROM tpl) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TERMS.format('text')})) AS term FROM documents) GROUP BY term
), idf AS (SELECT t.term, ln(((SELECT count(*) FROM documents) + 1.0) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT term FROM df UNION SELECT term FROM tt) t LEFT JOIN df ON t.term = df.term
), tw AS (SELECT tid, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY tid)) AS tw FROM tt JOIN idf USING (term)
), un AS (
  SELECT doc_id, -1 AS pos, coalesce(text, '') AS unit FROM documents
  UNION ALL SELECT doc_id, i, ls[i] FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
  UNION ALL SELECT doc_id, 1000000000 + i, bs[i] FROM (SELECT doc_id, bs, unnest(range(1, len(bs) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{license_scan.BLANK_LINES}') AS bs FROM documents))
), wd AS (SELECT doc_id, pos, {_TERMS.format('unit')} AS ws FROM un
), vec AS (
  SELECT doc_id, pos, term, count(*) * any_value(idf) AS w
  FROM (SELECT doc_id, pos, unnest(ws) AS term FROM wd WHERE list_has_any(ws, (SELECT list(term) FROM tt))) JOIN idf USING (term) GROUP BY ALL
), hit AS (
  SELECT doc_id, pos, license, tid, round(dot / norm, 6) AS score
  FROM (SELECT doc_id, pos, license, tid, sum(w * tw) AS dot FROM vec JOIN tw USING (term) GROUP BY ALL) JOIN (SELECT doc_id, pos, sqrt(sum(w * w)) AS norm FROM vec GROUP BY ALL) USING (doc_id, pos)
), hd AS (SELECT doc_id, arg_min(license, (-score, tid)) AS license, max(score) AS score FROM hit WHERE pos >= 0 AND score >= 0.8 GROUP BY doc_id
), fl AS (SELECT doc_id, arg_min(license, (-score, tid)) AS license, max(score) AS score FROM hit WHERE pos < 0 AND score >= 0.5 GROUP BY doc_id
), p AS (
  SELECT doc_id, CASE WHEN doc_id % 512 = 0 THEN source || '/' || (doc_id // 512) || '/LICENSE' WHEN doc_id % 32 = 0 THEN source || '/' || (doc_id // 512) || '/' || (doc_id // 32) || '/LICENSE'
    ELSE source || '/' || (doc_id // 512) || '/' || (doc_id // 32) || '/' || doc_id END AS path FROM documents
), r AS (
  SELECT p.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, coalesce(fl.license, hd.license) AS license, coalesce(fl.score, hd.score) AS score,
    CASE WHEN fl.license IS NOT NULL THEN 'file' WHEN hd.license IS NOT NULL THEN 'header' END AS how
  FROM p LEFT JOIN hd ON p.doc_id = hd.doc_id LEFT JOIN fl ON p.doc_id = fl.doc_id
), g AS (SELECT dir AS gdir, arg_min(license, (-score, license)) AS gl FROM r WHERE license IS NOT NULL AND (how = 'file' OR ends_with(path, '/LICENSE')) GROUP BY dir
), n AS (SELECT d.dir, arg_max(gdir, length(gdir)) AS gdir, arg_max(gl, length(gdir)) AS gl FROM (SELECT DISTINCT dir FROM r WHERE license IS NULL) d JOIN g ON gdir = '' OR d.dir = gdir OR starts_with(d.dir, gdir || '/') GROUP BY d.dir)
SELECT doc_id, path, coalesce(license, gl) AS license, coalesce(how, CASE WHEN gl IS NOT NULL THEN 'inherited' END, 'none') AS how, score, CASE WHEN license IS NULL THEN gdir END AS license_dir
FROM r LEFT JOIN n ON r.dir = n.dir""",
    "op3_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w
), t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o WHERE 100 * c >= 75 * (na + nb - c) UNION ALL SELECT b, a FROM o WHERE 100 * c >= 75 * (na + nb - c)
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), k AS (SELECT a, min(b) AS b FROM r GROUP BY a
), z AS (SELECT doc_id, list_sort(sh) AS sh, len(sh) AS n FROM s
), q AS (SELECT sh, count(*) AS m FROM z GROUP BY sh)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_shingles, least(z.doc_id, coalesce(k.b, z.doc_id)) AS component_id,
       CASE WHEN z.n = 0 THEN 1 ELSE q.m END AS class_size
FROM z LEFT JOIN k ON z.doc_id = k.a LEFT JOIN q ON z.sh = q.sh""",
    "op7_line_dedup": f"""
WITH l AS (
  SELECT doc_id, i AS pos, ls[i] AS line, translate(trim(ls[i], {_BLANK}), {_FOLD}) AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), hot AS (
  SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), f AS (
  SELECT l.*, hot.k IS NOT NULL AND l.doc_id <> hot.last AS gone FROM l LEFT JOIN hot ON l.k = hot.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id""",
    "op9_url_filters": f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), {_FOLD}), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r(verdict, rh, rp, rule) AS (
  VALUES ('allow', 'org', '/', 'org/'), ('block', 'example.org', '/es/', 'example.org/es/'),
         ('block', 'example.org', '/en/1', 'example.org/en/1'), ('allow', 'com', '/fr/', 'com/fr/'), ('block', 'com', '/de/', 'com/de/')
), m AS (
  SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC NULLS LAST, length(rp) DESC) AS n
  FROM p LEFT JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1""",
}
