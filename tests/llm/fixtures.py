"""Awkward documents that every operator has to take: nulls, empty and long texts, ties, repeated rows, extra columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    base = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one two three four five six seven", "en", "b", None), (5, "one two three four five six seven", "en", None, 33), (6, "word " * 30_000, "de", "a", 150_000), (7, "é日本語 mixed 𝔘nicode\x00 text", None, "b", 20), (None, "no id here", "fr", "b", 10)]
    rows = base + [base[3]]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("kept", "rule", "salt", "n", "size", "digest", "length", "y", "label"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
