"""Dense numbers over a whole table, and unused numbers, without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from credence.operators.graph import cut

_ROWS = 33  # monotonically_increasing_id: the partition above, the row in it below
#: Numbers that meet gaps in one bucket.
RUN = 1024


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """df with the place of each row, from 0, in this order; rows that it doesn't tell apart come in any order.

    Two passes: rows are dealt out by ranges and sorted within them, and written down, so that both passes see the same
    ranges; the rows of each range are counted, and what stands before a range is added to the places in it. The counts
    are one row a partition.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = cut(rows, "ordered").withColumn("__part", F.shiftright("__at", _ROWS))
    before, offsets = 0, []
    for part, n in sorted(rows.groupBy("__part").count().collect()):
        offsets.append((part, before))
        before += n
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part long, __before long"))
    within = F.col("__at").bitwiseAND((1 << _ROWS) - 1)
    return rows.join(starts, "__part").withColumn(name, F.col("__before") + within).drop("__at", "__part", "__before")


def unused(used: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with `id`: its k-th row (`number`, from 0) gets the k-th of the whole numbers from 0 that are not used.

    used: id. Between two used ids lies a run of unused ones, known by its length alone; runs and numbers meet in buckets of
    RUN numbers, so a run of any length is never spelled out.
    """
    ids = cut(numbered(used.filter("id >= 0").select("id").distinct(), "id"), "used")
    before = ids.select((F.col("number") + 1).alias("number"), F.col("id").alias("last"))
    runs = ids.join(before, "number", "left").select((F.coalesce("last", F.lit(-1)) + 1).alias("first"), "number", (F.col("id") - 1).alias("end"))
    top, n = ids.agg(F.coalesce(F.max("id"), F.lit(-1)), F.count("*")).first()
    most = wanted.agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0]
    beyond = df_row(used, first=top + 1, number=n, end=top + 1 + max(most, 0))
    # a run's first unused number is so many behind as there are used ones before it
    runs = runs.unionByName(beyond).filter("first <= end").select("first", (F.col("first") - F.col("number")).alias("a"), (F.col("end") - F.col("number")).alias("z")).filter(F.col("a") <= most)
    last = F.least("z", F.lit(most))
    runs = runs.withColumn("z", last).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / RUN), F.floor(F.col("z") / RUN))))
    rows = wanted.withColumn("bucket", F.floor(F.col("number") / RUN)).join(runs, "bucket").filter("number between a and z")
    return rows.withColumn("id", F.col("first") + F.col("number") - F.col("a")).drop("bucket", "first", "a", "z", "number")


def df_row(like: DataFrame, **values: int) -> DataFrame:
    return like.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in values.items()])
