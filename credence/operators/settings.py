"""Layered settings as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def layered(settings: DataFrame) -> DataFrame:
    """path, value, source: what holds when layers are laid over one another.

    settings: layer (higher ones win), source, path (names joined by dots), value. A null value says nothing. A scalar laid
    over a mapping removes what lies below it, and a mapping laid over a scalar removes the scalar.
    """
    said = settings.filter("value is not null")
    names = F.split("path", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, 1, k), "."))
    # Each path with itself and all that it lies in.
    rows = said.select("layer", "source", "path", "value", F.explode(above).alias("at"))
    last = rows.filter("at = path").groupBy("at").agg(F.max("layer").alias("scalar"))
    below = rows.filter("at <> path").groupBy("at").agg(F.max("layer").alias("mapping"))
    hidden = rows.join(last, "at").groupBy("path", "layer").agg(F.max(F.when(F.col("at") != F.col("path"), F.col("scalar"))).alias("over"), F.max(F.when(F.col("at") == F.col("path"), F.col("scalar"))).alias("same"))
    kept = said.join(hidden, ["path", "layer"]).join(below.withColumnRenamed("at", "path"), "path", "left")
    ok = (F.col("layer") == F.col("same")) & (F.col("layer") > F.coalesce("over", F.lit(-1))) & (F.col("layer") > F.coalesce("mapping", F.lit(-1)))
    one = F.row_number().over(Window.partitionBy("path").orderBy("source"))
    return kept.filter(ok).withColumn("n", one).filter("n = 1").select("path", "value", "source")
