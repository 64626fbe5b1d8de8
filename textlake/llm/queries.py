"""The operators' queries over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import decontaminate, langid, licenses, lines, near, packing, passages, quality, shards, urls
from textlake.llm._common import cut, documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir)).select("doc_id", *licenses.RESULT[:-1])


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decontaminate.mark_contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return made.select("doc_id", *decontaminate.RESULT[:-1])


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir)).select("doc_id", *near.RESULT)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir)).select("doc_id", *langid.RESULT)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = cut(documents(spark, sf_dir).select("doc_id", "lang", "source", quality.counts("text").alias("_counts")))
    return quality.judge(counted, counted="_counts").select("doc_id", *quality.RESULT)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(documents(spark, sf_dir, "pages")).select("page_id", *urls.RESULT)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(documents(spark, sf_dir)).select("doc_id", *shards.RESULT)


def queries() -> dict:
    every = (op1_substring_dedup, op2_line_dedup, op3_license_scan, op4_packing, op5_decontamination)
    return {f.__name__: f for f in (*every, op6_near_dedup, op7_language_id, op8_quality_rules, op9_url_filter, op10_sharding)}


#: ASCII lower case only, as everywhere here.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LINES = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text,''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text,''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keep AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

_DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS g FROM (SELECT item_id, unnest(list_transform(range(greatest(1, len(w) - 9)), lambda i: w[i + 1 : i + 10])) AS g FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON bw.n = dw.n AND array_to_string(w[i : i + dw.n - 1], ' ') = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(greatest(1, len(w) - 4)), lambda i: hash(array_to_string(w[i + 1 : i + 5], ' ')))) AS s FROM d WHERE len(w) > 0),
c AS (SELECT list_sort(s) AS s, min(doc_id) AS id, len(s) AS n FROM s GROUP BY 1, 3),
x AS (SELECT id, n, unnest(s) AS v FROM c),
o AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM x a JOIN x b ON a.v = b.v AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM o WHERE 100 * i >= 85 * (na + nb - i)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, comp) AS (SELECT id, id FROM c UNION SELECT e2.b, r.comp FROM r JOIN e2 ON e2.a = r.id AND r.comp < e2.b),
m AS (SELECT id, min(comp) AS comp FROM r GROUP BY id)
SELECT d.doc_id, coalesce(len(s.s), 0) AS n_shingles, coalesce(m.comp, d.doc_id) AS component_id, d.doc_id = coalesce(m.comp, d.doc_id) AS kept
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN m ON m.id = c.id
"""


def oracle_sql() -> dict:
    return {"op2_line_dedup": _LINES, "op5_decontamination": _DECONTAMINATION, "op6_near_dedup": _NEAR}
