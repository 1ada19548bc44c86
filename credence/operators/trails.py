"""Relations arranged as trails: paths on which each relation begins where the one before it ends.

At each node the incoming relations, in order, are paired with the outgoing ones, in order: each relation has one
successor at most, and one predecessor at most, so that each lies in one trail. A ring of relations is cut before its
smallest id.

How far along its trail a relation stands is found by pointer jumping: every relation knows one that is some steps before it, and
in each round takes over what that one knows. A trail of n relations takes log2(n) rounds, each one a join of two narrow tables.

Nulls and edges: a relation without an end is a trail of its own; several rows of one id count as one, by the smallest
ends and order; a relation from a node to itself is paired like others, and may be a ring of one; an empty table has no trails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from credence.operators.graph import cut


def successors(relations: DataFrame) -> DataFrame:
    """item_id, id, next: what follows each relation that something follows. relations: item_id, id, from_id, to_id, priority."""
    place = lambda end: F.row_number().over(Window.partitionBy("item_id", end).orderBy("priority", "id"))
    comes = relations.filter("to_id is not null").select("item_id", "id", F.col("to_id").alias("node"), place("to_id").alias("k"))
    goes = relations.filter("from_id is not null").select("item_id", F.col("id").alias("next"), F.col("from_id").alias("node"), place("from_id").alias("k"))
    return comes.join(goes, ["item_id", "node", "k"]).select("item_id", "id", "next")


def _jumped(rows: DataFrame) -> DataFrame:
    """item_id, id, head, place, low, ring. rows: item_id, id, before (null at a head).

    ring: nothing but a ring has a pointer left once the least id that it has seen is the same for one and two steps.
    """
    here = F.col("before").isNull()
    state = rows.select("item_id", "id", "before", F.col("id").alias("head"), F.when(here, 0).otherwise(1).cast("long").alias("place"), F.col("id").alias("low"), F.lit(False).alias("moved"))
    state = cut(state, "trails")
    while True:
        known = state.select("item_id", F.col("id").alias("__id"), F.col("before").alias("__before"), F.col("head").alias("__head"), F.col("place").alias("__place"), F.col("low").alias("__low"))
        going = state.filter("before is not null").join(known.withColumnRenamed("__id", "before"), ["item_id", "before"])
        low = F.least("low", "__low")
        moved = F.col("__before").isNull() | (low < F.col("low"))
        # a pointer at a head has got there: what is left is the head itself
        going = going.select("item_id", "id", F.col("__before").alias("before"), F.col("__head").alias("head"), (F.col("place") + F.col("__place")).alias("place"), low.alias("low"), moved.alias("moved"))
        state = cut(state.filter("before is null").withColumn("moved", F.lit(False)).unionByName(going), "trails")
        if state.filter("moved").isEmpty():
            return state.withColumn("ring", F.col("before").isNotNull()).drop("before", "moved")


def trails(relations: DataFrame) -> DataFrame:
    """item_id, id, trail (the id of its first relation), place (from 0). relations: item_id, id, from_id, to_id, priority."""
    once = relations.groupBy("item_id", "id").agg(*[F.min(c).alias(c) for c in ("from_id", "to_id", "priority")])
    once = cut(once, "relations")
    following = cut(successors(once), "successors")
    before = following.select("item_id", F.col("next").alias("id"), F.col("id").alias("before"))
    found = _jumped(once.select("item_id", "id").join(before, ["item_id", "id"], "left"))
    paths = found.filter("not ring").select("item_id", "id", F.col("head").alias("trail"), "place")
    rings = found.filter("ring").select("item_id", "id", "low")
    if rings.isEmpty():
        return paths
    opened = rings.join(before, ["item_id", "id"]).select("item_id", "id", F.when(F.col("id") != F.col("low"), F.col("before")).alias("before"))
    return paths.unionByName(_jumped(opened).select("item_id", "id", F.col("head").alias("trail"), "place"))


def lines(relations: DataFrame, found: DataFrame) -> DataFrame:
    """item_id, trail, place, line of each relation as it is shown, trails by the priority of their first relation.

    relations: also type and, if it has one, note.
    """
    note = F.trim(F.regexp_replace("note", r"\s+", " ")) if "note" in relations.columns else F.lit("")
    base = F.concat(F.lit("- [B"), F.col("from_id"), F.lit("] "), F.col("type"), F.lit(" [B"), F.col("to_id"), F.lit("]"))
    text = F.concat(base, F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit(" — "), note)).otherwise(F.lit("")))
    rows = relations.select("item_id", "id", "priority", text.alias("line")).join(found, ["item_id", "id"])
    first = F.min(F.when(F.col("place") == 0, F.col("priority"))).over(Window.partitionBy("item_id", "trail"))
    order = Window.partitionBy("item_id").orderBy("first", "trail", "place")
    return rows.withColumn("first", first).withColumn("n", F.row_number().over(order)).select("item_id", "n", "trail", "place", "line")
