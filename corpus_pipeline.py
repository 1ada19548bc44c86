"""A corpus pipeline of five stages; each works on all that its predecessor kept.

Part of the `llm` package in all but place. Stages take (spark, docs, sf_dir); all but the last return the columns of
`documents`. `run` writes each stage's result into the shared folder and reads it back for the next.

Nulls and edges: a null or empty text fails the base rules and goes in the first stage, so a table of such rows, or an
empty one, gives an empty result; rows without an id stay, as they can't be told to be copies; repeated rows of one id count
once from the second stage on; a null source is a source of its own; labels may be empty (only the base rules act then)
or of one kind; further columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credence.llm import mixing, neardup, packing, pii, quality
from credence.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_duplicates), ("PII", personal_data), ("mixing", source_mixing), ("packing", best_fit_packing)]
#: Tokenising and learned rules are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
