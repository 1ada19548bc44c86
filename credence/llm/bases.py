"""The parts of operators that SQL can say, as queries of their own beside that SQL.

op2, op4 and op8 add a learned list, transducers and rounding to these, which SQL can't express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from credence.llm import mixing, pii, quality
from credence.llm.common import documents, materialise, table


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op2 and whether they fail a document."""
    rows = quality.with_counts(documents(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", *quality.COUNTS, quality.base_failed().alias("base_failed"))


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op4's base spans."""
    return pii.detect(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's sizes and targets."""
    narrow = materialise(mixing.sizes(table(spark, sf_dir, "documents")), "sizes")
    totals = narrow.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    goal = mixing.targets(totals).select(F.col("source").alias("g_source"), F.col("total").alias("source_size"), F.round("target", 4).alias("target"))
    return narrow.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).select("doc_id", "size", "source_size", "target")


WORD = r"'[^\x20\x09-\x0D]+'"
QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {WORD}) GROUP BY doc_id),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 5)),
q AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM q CROSS JOIN (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id
"""
PERSONAL_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS (
  SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
    regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips, regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+') AS cards, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]') AS phones FROM d
), n AS (
  SELECT *, list_filter(list_transform(cards, lambda x: list_reverse(string_split(regexp_replace(x, '[^0-9]', '', 'g'), ''))), lambda x: len(x) BETWEEN 14 AND 19) AS digits FROM m
)
SELECT doc_id, CAST(n_email AS BIGINT) AS n_email,
  CAST(len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda y: CAST(y AS HUGEINT) > 255)) = 0)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(digits, lambda x: list_sum(list_transform(x, lambda y, i: CASE WHEN i % 2 = 1 THEN CAST(y AS INTEGER) WHEN CAST(y AS INTEGER) > 4 THEN 2 * CAST(y AS INTEGER) - 9 ELSE 2 * CAST(y AS INTEGER) END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(phones, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone
FROM n
"""
MIXING_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORD})) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY source),
s AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM t),
u AS (SELECT 0 AS step, 0.0::DOUBLE AS unit UNION ALL
  SELECT step + 1, (SELECT (1.5::DOUBLE * sum(total) - 2.0::DOUBLE * coalesce(sum(total) FILTER (w * u.unit > 2 * total), 0)) / sum(w) FILTER (w * u.unit <= 2 * total) FROM s) FROM u
  WHERE step < 60 AND (SELECT count(*) FROM s WHERE w * u.unit <= 2 * total) > 0),
z AS (SELECT max(unit) AS unit FROM u)
SELECT d.doc_id, d.size, s.total AS source_size, round(least(s.w * z.unit, 2.0::DOUBLE * s.total), 4) AS target FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source, z
"""
QUERIES = {f.__name__: f for f in (quality_base, personal_data_base, mixing_targets)}
ORACLE_SQL = {"quality_base": QUALITY_SQL, "personal_data_base": PERSONAL_SQL, "mixing_targets": MIXING_SQL}
