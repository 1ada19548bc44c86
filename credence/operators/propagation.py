"""Confidence carried along relations: bounded synchronous rounds, each a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from credence.functions import confidence as C
from credence.operators.graph import cut


def contributions(nodes: DataFrame, relations: DataFrame, policy: C.Policy = C.Policy()) -> DataFrame:
    """item_id, relation_id, output_id, input_id, strength, contribution of every relation that carries something.

    nodes: item_id, id, confidence and, if known, procedural. Strict: an input at its threshold is inactive. Procedural
    outputs can't be supported.
    """
    kind, a, b = F.col("type"), F.col("from_id"), F.col("to_id")
    rows = relations.filter(kind.isin("depends_on", "contradicts")).select(
        "item_id", F.col("id").alias("relation_id"), C.relation_output(kind, a, b).alias("output_id"), C.relation_input(kind, a, b).alias("input_id"), C.relation_sign(kind).alias("sign"),
        C.relation_weight(F.col("weight"), policy.default_weight).alias("w"), C.relation_threshold(F.col("threshold"), policy.threshold).alias("t"),
    )
    inputs = nodes.select("item_id", F.col("id").alias("input_id"), F.col("confidence").alias("c"))
    procedural = F.coalesce("procedural", F.lit(False)) if "procedural" in nodes.columns else F.lit(False)
    outputs = nodes.select("item_id", F.col("id").alias("output_id"), procedural.alias("procedural"))
    rows = rows.join(inputs, ["item_id", "input_id"]).join(outputs, ["item_id", "output_id"]).filter("not (procedural and sign > 0)")
    strength = C.activation(F.col("c"), F.col("t"))
    return rows.withColumn("strength", strength).filter("strength > 0").select("item_id", "relation_id", "output_id", "input_id", "strength", (F.col("sign") * F.col("w") * F.col("strength")).alias("contribution"))


def strongest(carried: DataFrame) -> DataFrame:
    """item_id, output_id, factor, relation_ids: only the strongest support and the strongest contradiction count."""
    c, key = F.col("contribution"), F.struct(F.abs(F.col("contribution")), -F.col("relation_id"))
    plus, minus = F.when(c > 0, c), F.when(c < 0, c)
    rows = carried.groupBy("item_id", "output_id").agg(
        F.max(plus).alias("p"), F.min(minus).alias("m"), F.max_by("relation_id", F.when(c > 0, key)).alias("p_id"), F.max_by("relation_id", F.when(c < 0, key)).alias("m_id")
    )
    return rows.select("item_id", "output_id", F.round(F.coalesce("p", F.lit(0.0)) + F.coalesce("m", F.lit(0.0)), 6).alias("factor"), F.array_sort(F.array_compact(F.array("p_id", "m_id"))).alias("relation_ids"))


def _round(nodes: DataFrame, relations: DataFrame, policy: C.Policy, first: bool) -> DataFrame:
    """One synchronous round over the frontier: outputs fed by what moved in the round before (all outputs in the first)."""
    moved = nodes.filter("moved").select("item_id", F.col("id").alias("input_id"))
    feeds = relations.select("item_id", C.relation_output(F.col("type"), F.col("from_id"), F.col("to_id")).alias("output_id"), C.relation_input(F.col("type"), F.col("from_id"), F.col("to_id")).alias("input_id")).filter("output_id is not null")
    frontier = (feeds if first else feeds.join(moved, ["item_id", "input_id"], "left_semi")).select("item_id", F.col("output_id").alias("id")).distinct().withColumn("__front", F.lit(True))
    factors = strongest(contributions(nodes, relations, policy)).select("item_id", F.col("output_id").alias("id"), F.col("factor").alias("__f"))
    rows = nodes.join(frontier, ["item_id", "id"], "left").join(factors, ["item_id", "id"], "left")
    factor = F.coalesce("__f", F.lit(0.0))
    new = C.posterior(F.col("initial_confidence"), F.col("evidence_confidence"), factor)
    d = F.lit(policy.min_delta)
    old_factor = F.coalesce("factor_confidence", F.lit(0.0))
    changed = F.coalesce("__front", F.lit(False)) & ((F.abs(factor - old_factor) > d) | (F.abs(new - F.col("confidence")) > d))
    rows = rows.withColumn("__new", new).withColumn("__factor", factor).withColumn("__changed", changed)
    rows = rows.withColumn("moved", F.col("__changed") & (F.abs(F.col("__new") - F.col("confidence")) > d))
    rows = rows.withColumn("confidence", F.when(F.col("__changed"), F.col("__new")).otherwise(F.col("confidence"))).withColumn("factor_confidence", F.when(F.col("__changed"), F.col("__factor")).otherwise(old_factor))
    return rows.select("item_id", "id", "initial_confidence", "evidence_confidence", "factor_confidence", "confidence", "procedural", "moved")


def propagated(nodes: DataFrame, relations: DataFrame, policy: C.Policy = C.Policy(), rounds: int | None = None) -> DataFrame:
    """nodes after at most three rounds. A state is read several times by the next round, so each but the last is written down.

    A round is skipped by nodes off its frontier, so after the last change all further rounds leave all as it is.
    """
    rows = nodes.select(
        "item_id", "id", F.coalesce("initial_confidence", F.lit(None).cast("double")).alias("initial_confidence"), F.coalesce("evidence_confidence", F.lit(0.0)).alias("evidence_confidence"),
        F.coalesce("factor_confidence", F.lit(0.0)).alias("factor_confidence"), "confidence", (F.col("procedural") if "procedural" in nodes.columns else F.lit(False)).alias("procedural"), F.lit(True).alias("moved"),
    )
    n = min(C.MAX_ROUNDS, rounds or policy.max_rounds)
    if n > 1:
        rows, relations = cut(rows, "state"), cut(relations, "relations")
    for k in range(n):
        rows = _round(rows, relations, policy, k == 0)
        if k + 1 < n:
            rows = cut(rows, "state")
    return rows.drop("moved")


def contribution_of(kind: Column, weight: Column, threshold: Column, confidence: Column, policy: C.Policy = C.Policy()) -> Column:
    """A single relation's contribution, given its input's confidence."""
    return C.relation_sign(kind) * C.relation_weight(weight, policy.default_weight) * C.activation(confidence, C.relation_threshold(threshold, policy.threshold))
