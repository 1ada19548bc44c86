"""The queries of this package, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credence.llm import audit, bases, langid, licences, mixing, neardup, packing, pages, periodic, pii, quality, repeats, search, suffixes
from credence.llm.common import table


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op10_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.per_document(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_quality_rules, op3_html_extraction, op4_personal_data, op5_packing, op6_near_duplicates, op7_language, op8_mixing, op9_licences, op10_repeated_lines, op11_suffix_dedup, op12_filter_audit, op13_periodic_runs)} | bases.QUERIES
ORACLE_SQL = {"op1_exact_top_k": search.ORACLE_SQL, "op6_near_duplicates": neardup.ORACLE_SQL, "op10_repeated_lines": repeats.ORACLE_SQL, "op11_suffix_dedup": suffixes.ORACLE_SQL, "op12_filter_audit": audit.ORACLE_SQL, "op13_periodic_runs": periodic.ORACLE_SQL} | bases.ORACLE_SQL
