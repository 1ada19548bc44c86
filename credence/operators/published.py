"""Constructed graphs as the public form: nodes with their layer and the evidence they name, relations between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from credence.operators import relations as R

#: Roles whose words come from outside; all others reason. Fixed values.
OUTER_ROLES = ("user", "tool", "function")
_LONGS = "array<bigint>"


def nodes(built: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row a node that says something, in the public form.

    built: item_id, id, node_type, belief, decision, role, source_role, stance, turn_id, evidence_ids, confidence (any but the first
    two may be null). A node says its belief, or else its decision; blank ones go. A role is the node's, its source's, or
    unknown; the layer follows from it. Stance, confidence and lists have defaults.
    evidence: item_id, id, text, role, turn_id. Named evidence without text, or not there at all, is passed over; the rest keeps
    the node's order, repeats included, and takes the node's role where it has none. Only keys and evidence are shuffled
    for the lookup; the nodes' other columns join once, at the end.
    """
    said = F.trim(F.coalesce(F.when(F.col("belief") != "", F.col("belief")), F.col("decision")))
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    role = F.coalesce(given("role"), given("source_role"), F.lit("unknown"))
    rows = built.filter("id is not null").select(
        "item_id", "id", F.when(F.col("node_type") == "decision", "decision").otherwise("belief").alias("node_type"), said.alias("belief"), given("decision").alias("decision"),
        F.coalesce(given("stance"), F.lit("asserted")).alias("stance"), F.when(role.isin(*OUTER_ROLES), "io").otherwise("reasoning").alias("layer"), role.alias("role"),
        F.coalesce("turn_id", F.lit(-1).cast("long")).alias("trajectory_index"), F.coalesce("evidence_ids", F.array().cast(_LONGS)).alias("evidence_ids"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    ).filter("belief <> ''")
    named = rows.select("item_id", F.col("id").alias("node_id"), "role", F.posexplode("evidence_ids").alias("pos", "id"))
    told = evidence.filter("text <> ''").select("item_id", "id", "text", F.col("role").alias("own_role"), F.coalesce("turn_id", F.lit(-1).cast("long")).alias("turn_id"))
    own = F.coalesce(F.when(F.col("own_role") != "", F.col("own_role")), F.col("role"))
    found = named.join(told, ["item_id", "id"]).select("item_id", "node_id", F.struct("pos", F.struct("id", "text", own.alias("role"), F.col("turn_id").alias("trajectory_index")).alias("e")).alias("x"))
    lists = found.groupBy("item_id", F.col("node_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("evidence"))
    none = F.array().cast(lists.schema["evidence"].dataType)
    return rows.join(lists, ["item_id", "id"], "left").withColumn("evidence", F.coalesce("evidence", none))


def relations(built: DataFrame, public_nodes: DataFrame) -> DataFrame:
    """Those whose ends both became public nodes."""
    return R.with_endpoints(built, public_nodes)
