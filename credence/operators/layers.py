"""The window a relation model reads: a turn's new nodes and those of the turns before it, under one budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def turn_windows(nodes: DataFrame, k: int = 3) -> DataFrame:
    """item_id, turn_id, id, layer, text: for each turn that has nodes, its own (layer null) and those of up to k turns before.

    A node goes to the windows it is part of, so no pair is ever joined: one shuffle by item for this and the rendering.
    nodes: item_id, id, turn_id, text.
    """
    layer = F.dense_rank().over(Window.partitionBy("item_id").orderBy("turn_id"))
    rows = nodes.select("item_id", "id", "turn_id", "text", layer.alias("own"))
    rows = rows.withColumn("window", F.explode(F.sequence(F.col("own"), F.col("own") + k)))
    distance = F.col("window") - F.col("own")
    # Past an item's last turn there are windows without a turn of their own; they go.
    turn = F.max(F.when(distance == 0, F.col("turn_id"))).over(Window.partitionBy("item_id", "window"))
    rows = rows.withColumn("turn_id", turn).filter("turn_id is not null")
    return rows.select("item_id", "turn_id", "id", F.when(distance > 0, distance).alias("layer"), "text")


def quoted(text: Column) -> Column:
    """A JSON string."""
    record = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t")))
    return F.substring(record, F.lit(6), F.length(record) - 6)


def shortened(text: Column, most: int = 240, kept: int = 220) -> Column:
    """Texts longer than `most` cut to their first `kept` characters and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, kept), F.lit(" …"))).otherwise(F.coalesce(text, F.lit("")))


def _listed(entries: Column) -> Column:
    lines = F.transform(F.array_sort(entries), lambda e: F.concat(F.lit("  "), e["line"]))
    return F.concat(F.lit("[\n"), F.array_join(lines, ",\n"), F.lit("\n]"))


def rendered(windows: DataFrame, budget: int | None = 9000) -> DataFrame:
    """item_id, turn_id, previous, current, retained, omitted: two lists of JSON lines that share one budget.

    The smallest ids go first until the rest fits (a line counts four characters more), whichever list they are in. A
    window that nothing fits keeps its row, with two empty lists. windows: as of `turn_windows`; rows without an id are
    passed over; one id in both lists counts twice, the previous one older.
    """
    new = F.col("layer").isNull()
    depth = F.when(new, F.lit("")).otherwise(F.concat(F.lit(', "layer": '), F.col("layer").cast("string")))
    line = F.concat(F.lit('{"id": '), F.col("id").cast("string"), depth, F.lit(', "content": '), quoted(shortened(F.col("text"))), F.lit("}"))
    rows = windows.filter("id is not null").withColumn("new", new).withColumn("line", line)
    newest = Window.partitionBy("item_id", "turn_id").orderBy(F.desc("id"), F.desc("new"), F.desc("line")).rowsBetween(Window.unboundedPreceding, 0)
    fits = F.lit(True) if budget is None else F.sum(F.length("line") + 4).over(newest) <= budget
    rows = rows.withColumn("fits", fits)
    some = lambda keep: F.collect_list(F.when(F.col("fits") & keep, F.struct("id", "line")))
    return rows.groupBy("item_id", "turn_id").agg(
        _listed(some(~F.col("new"))).alias("previous"), _listed(some(F.col("new"))).alias("current"),
        F.array_sort(F.collect_set(F.when(F.col("fits"), F.col("id")))).alias("retained"), F.count_if(~F.col("fits")).alias("omitted"),
    )
