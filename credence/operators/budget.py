"""Selections under a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def newest_suffix(rows: DataFrame, cost: Column, budget: int, by: str = "item_id", order: str = "id") -> DataFrame:
    """The longest run of the newest rows that fits: the oldest are dropped until it does."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("__u", F.sum(cost).over(w)).filter(F.col("__u") <= budget).drop("__u")


def greedy(rows: DataFrame, budgets: dict[str, int], by: str = "item_id") -> DataFrame:
    """by, kind, ids, used: best first, what doesn't fit is passed over and the rest goes on.

    rows: by, id, kind, score, turn_id, cost. A fold over the sorted rows of one item, without Python: skipping can't be
    said with a running sum.
    """
    entry = F.struct((-F.col("score")).alias("s"), (-F.col("turn_id")).alias("t"), (-F.col("id")).alias("i"), F.col("cost").cast("long").alias("cost"))
    g = rows.groupBy(by, "kind").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    limit = None
    for k, b in budgets.items():
        limit = F.when(F.col("kind") == k, F.lit(b)) if limit is None else limit.when(F.col("kind") == k, F.lit(b))
    g = g.withColumn("limit", limit.otherwise(F.lit(0)).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    take = lambda acc, x: F.when(acc["used"] + x["cost"] <= F.col("limit"), F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["ids"], F.array(-x["i"])).alias("ids"))).otherwise(acc)
    return g.withColumn("r", F.aggregate("e", start, take)).select(by, "kind", F.col("r.ids").alias("ids"), F.col("r.used").alias("used"))


def until_full(rows: DataFrame, budget: int, separator: int = 2, least_rest: int = 80, by: str = "item_id") -> DataFrame:
    """by, text: sections in order until one doesn't fit; that one is cut if more than `least_rest` characters remain, then it stops.

    rows: by, seq, section.
    """
    w = Window.partitionBy(by).orderBy("seq")
    rows = rows.withColumn("n", F.row_number().over(w))
    end = F.sum(F.length("section") + F.when(F.col("n") > 1, separator).otherwise(0)).over(w)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("section"))
    first_out = F.min(F.when(F.col("end") > budget, F.col("n"))).over(Window.partitionBy(by))
    rows = rows.withColumn("out", first_out)
    room = F.lit(budget) - F.col("start")
    cut = F.when((F.col("n") == F.col("out")) & (room > least_rest), F.concat(F.rtrim(F.substring(F.col("section"), F.lit(1), (room - 1).cast("int"))), F.lit("…")))
    shown = F.when(F.col("out").isNull() | (F.col("n") < F.col("out")), F.col("section")).otherwise(cut)
    return rows.withColumn("shown", shown).filter("shown is not null").groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "shown"))), lambda x: x["shown"]), "\n\n").alias("text"))


def rendered_nodes(nodes: DataFrame, budget: int, with_ids: bool = True, most_chars: int | None = None) -> DataFrame:
    """item_id, text: nodes by id, the oldest dropped to fit; long texts cut to most_chars - 20 and an ellipsis."""
    t = F.trim("text")
    t = t if most_chars is None else F.when(F.length(t) > most_chars, F.concat(F.rtrim(F.substring(t, 1, most_chars - 20)), F.lit(" …"))).otherwise(t)
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), t) if with_ids else F.concat(F.lit("- "), t)
    kept = newest_suffix(nodes.withColumn("line", line), F.length("line") + 4, budget)
    return kept.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("n"))
