"""Merging alike nodes: candidate pairs, groups, gates, what a merge leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from credence.operators import metric


def compact(nodes: DataFrame) -> DataFrame:
    return nodes.select("item_id", "id", F.col("node_type").alias("type"), "role", F.col("turn_id").alias("turn"), "stance", F.round("confidence", 3).alias("conf"), "entities", "text")


def new_ids(nodes: DataFrame, label: str) -> DataFrame:
    """The nodes of turn k for a label turn_<k>; none for other labels."""
    k = label.rpartition("_")[2]
    return nodes.filter(F.col("turn_id") == int(k)) if label.startswith("turn_") and k.isdigit() else nodes.limit(0)


def mergeable(nodes: DataFrame) -> DataFrame:
    """Active nodes that can merge: no decisions, no rule-made tool nodes."""
    return nodes.filter(F.coalesce("active", F.lit(True)) & (F.col("node_type") != "decision") & ~F.coalesce(F.col("extraction_method").isin("rule_tool_call", "rule_tool_result"), F.lit(False)))


def query_identity() -> Column:
    """What a query node must share to merge with another: kind, tool and query or arguments; null for other nodes."""
    q = F.nullif(F.trim("query"), F.lit(""))
    a = F.nullif(F.nullif(F.col("tool_arguments"), F.lit("")), F.lit("{}"))
    return F.when(q.isNotNull(), F.struct(F.lit("query").alias("kind"), "tool_name", q.alias("v"))).when(a.isNotNull(), F.struct(F.lit("arguments").alias("kind"), "tool_name", a.alias("v")))


def similar_pairs(nodes: DataFrame, threshold: float, blocks: tuple[str, ...] = ("item_id", "role", "node_type"), incremental: bool = False) -> DataFrame:
    """a < b, similarity of nodes of one block whose vectors are alike. nodes: id, vector (+ is_new).

    The gate is part of the join keys, so pairs across roles or types are never formed; incremental: only new nodes ask, so
    old ones never meet. Cells of a metric index rule vectors out; the rest meet in matrix products of tiles (`metric`).
    """
    return metric.alike(nodes, threshold, blocks, incremental)


def groups(pairs: DataFrame, is_new: DataFrame | None = None) -> DataFrame:
    """group_id (its smallest id), id. Without is_new: connected components. With it (id, is_new): components of new
    nodes, each attached to at most one old anchor, the most similar, then the smallest id."""
    from credence.operators.graph import components, cut

    pairs = cut(pairs, "pairs")  # read several times
    if is_new is None:
        nodes = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        return components(nodes, pairs.select("a", "b")).select(F.col("comp").alias("group_id"), "id")
    flags = lambda c: is_new.select(F.col("id").alias(c), F.col("is_new").alias(f"{c}_new"))
    p = pairs.join(flags("a"), "a").join(flags("b"), "b")
    fresh = is_new.filter("is_new").select("id")
    comp = components(fresh, p.filter("a_new and b_new").select("a", "b"))
    mixed = p.filter("a_new <> b_new").select(F.when(F.col("a_new"), F.col("a")).otherwise(F.col("b")).alias("id"), F.when(F.col("a_new"), F.col("b")).otherwise(F.col("a")).alias("old"), "similarity")
    anchor = mixed.join(comp, "id").groupBy("comp").agg(F.max_by("old", F.struct("similarity", -F.col("old"))).alias("anchor"))
    sized = comp.join(anchor, "comp", "left")
    members = sized.select(F.coalesce("anchor", "comp").alias("group_id"), "id").union(anchor.select(F.col("anchor").alias("group_id"), F.col("anchor").alias("id"))).distinct()
    n = F.count("*").over(Window.partitionBy("group_id"))
    return members.withColumn("__n", n).filter("__n > 1").drop("__n")


def gated(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Groups whose members share their query identity; mixed ones are skipped whole."""
    rows = members.join(nodes.select("id", query_identity().alias("q")), "id")
    ok = rows.groupBy("group_id").agg(F.count_distinct(F.to_json("q")).alias("kinds"), F.count_if(F.col("q").isNull()).alias("none"), F.count("*").alias("n")).filter("(none = n) or (none = 0 and kinds = 1)").select("group_id")
    return members.join(ok, "group_id", "left_semi")


def split_by_gate(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Proposed groups cut by role, type and query identity; parts of one are dropped. group_id, part, id."""
    rows = members.join(nodes.select("id", "role", "node_type", F.to_json(query_identity()).alias("q")), "id")
    keys = ["group_id", "role", "node_type", "q"]
    w = Window.partitionBy(*keys)
    return rows.withColumn("n", F.count("*").over(w)).withColumn("part", F.min("id").over(w)).filter("n > 1").select("group_id", "part", "id")


def validated_proposals(proposals: DataFrame, allowed: DataFrame) -> DataFrame:
    """Proposed groups (proposal, id) of allowed ids, each id in its first proposal only, of two members at least."""
    ok = proposals.join(allowed.select("id"), "id", "left_semi").distinct()
    first = F.min("proposal").over(Window.partitionBy("id"))
    kept = ok.withColumn("f", first).filter("f = proposal").drop("f")
    return kept.withColumn("n", F.count("*").over(Window.partitionBy("proposal"))).filter("n > 1").drop("n")


def applied(members: DataFrame, nodes: DataFrame, keep_newest_text: bool = False, hybrid: bool = False) -> DataFrame:
    """What remains of each group: canonical id (the smallest), text, evidence in order, lineage; `absorbed` its others.

    hybrid: entities are cleared. keep_newest_text: the text of the newest member.
    """
    rows = members.join(nodes, "id")
    order = F.array_sort(F.collect_list(F.struct("id", "evidence_ids", "merged_from")))
    newest = F.max_by("text", F.struct("turn_id", "id"))
    out = rows.groupBy("group_id").agg(F.min("id").alias("id"), F.min_by("text", "id").alias("first_text"), newest.alias("newest_text"), order.alias("m"), F.flatten(F.collect_list("entities")).alias("entities"))
    flat = lambda f: F.array_distinct(F.flatten(F.transform("m", lambda x: F.coalesce(x[f], F.array().cast("array<bigint>")))))
    absorbed = F.array_sort(F.filter(F.transform("m", lambda x: x["id"]), lambda i: i != F.col("id")))
    lineage = F.array_sort(F.array_distinct(F.concat(absorbed, flat("merged_from"))))
    entities = F.array().cast("array<string>") if hybrid else F.array_sort(F.array_distinct("entities"))
    return out.select("id", (F.col("newest_text") if keep_newest_text else F.col("first_text")).alias("text"), flat("evidence_ids").alias("evidence_ids"), absorbed.alias("absorbed"), lineage.alias("merged_from"), entities.alias("entities"))


def mapping(merged: DataFrame) -> DataFrame:
    """old_id, new_id of all that was absorbed."""
    return merged.select(F.explode("absorbed").alias("old_id"), F.col("id").alias("new_id"))


def merge_pass(nodes: DataFrame, relations: DataFrame, threshold: float, incremental: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, groups, gate, merge, relations remapped. Returns (nodes, relations, merges). nodes: one item's, with vector."""
    from credence.operators.relations import remapped

    can = mergeable(nodes)
    pairs = similar_pairs(can, threshold, incremental=incremental)
    members = gated(groups(pairs, can.select("id", "is_new") if incremental else None), nodes)
    merged = applied(members, nodes)
    gone = merged.select(F.explode("absorbed").alias("id"))
    m = merged.select("id", F.col("text").alias("__t"), F.col("evidence_ids").alias("__e"), F.col("merged_from").alias("__m"), F.col("entities").alias("__n"))
    kept = nodes.join(gone, "id", "left_anti").join(m, "id", "left")
    for c, x in (("text", "__t"), ("evidence_ids", "__e"), ("merged_from", "__m"), ("entities", "__n")):
        kept = kept.withColumn(c, F.coalesce(x, c)).drop(x)
    moved = mapping(merged).withColumn("item_id", F.lit(None).cast("string"))
    ids = nodes.select("id", F.col("item_id").alias("__i"))
    moved = moved.drop("item_id").join(ids, moved["new_id"] == ids["id"]).select(F.col("__i").alias("item_id"), "old_id", "new_id")
    return kept, remapped(relations, moved), merged
