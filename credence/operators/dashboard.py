"""Raw JSON nodes and edges of any known shape as a dashboard's rows. Each record is parsed once, into text fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Spellings of node types without separators, and classes of sources. Fixed values.
NODE_TYPES = {"evidence": "Evidence", "claim": "Claim", "beliefvariable": "BeliefVariable", "belief": "BeliefVariable", "factor": "Factor", "decision": "Decision"}
SOURCE_CLASSES = ("user_input", "llm_reasoning", "tool_result", "historical_retrieval", "tool_call", "assistant_other")
SOURCE_NAMES = {"message": "user_input", "dashboard": "user_input", "model_reasoning": "llm_reasoning"}

_INNER = "type string, label string, name string, posterior string, status string, source_type string, stance string, layer string, belief string, claim string, trajectory_index string, x string, y string"
_NODE = f"id string, uuid string, type string, node_type string, label string, name string, posterior string, confidence string, probability string, status string, source_type string, stance string, layer string, belief string, decision string, x string, y string, payload struct<{_INNER.replace(' string', ': string')}>, metadata struct<{_INNER.replace(' string', ': string')}>"
_EDGE_INNER = "type: string, relation: string, dir: string, _dir: string, note: string, weight: string"
_EDGE = f"id string, uuid string, type string, label string, source string, from_id string, target string, to_id string, note string, weight string, payload struct<{_EDGE_INNER}>, metadata struct<{_EDGE_INNER}>"


def _first(*paths: str) -> Column:
    return F.coalesce(*(F.col(f"r.{p}") for p in paths))


def _said(*paths: str) -> list[Column]:
    return [F.when(F.col(f"r.{p}") != "", F.col(f"r.{p}")) for p in paths]


def _number(c: Column) -> Column:
    """A finite number, or null."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def _mapped(key: Column, names: dict[str, str], other: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(v) for kv in names.items() for v in kv))[key], F.lit(other))


def node_type(c: Column) -> Column:
    return _mapped(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[_\s-]+", "")), NODE_TYPES, "Claim")


def source_class(c: Column) -> Column:
    key = F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[\s-]+", "_"))
    return _mapped(key, {**{k: k for k in SOURCE_CLASSES}, **SOURCE_NAMES}, "assistant_other")


def relation_type(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    refuted, confirmed = low.contains("contradict") | low.contains("refute"), low.contains("confirm") | low.contains("support")
    return F.when(refuted, "contradicts").when(confirmed, "confirms").when(low.contains("extend"), "extends").otherwise("informs")


def nodes(raw: DataFrame) -> DataFrame:
    """graph, pos and a node's fields, each from the first place that has it: the node, its payload, its metadata.

    raw: graph, pos, json. What is no JSON object is a node with nothing but its position; a payload or metadata that is no object
    counts as none. A node without an id takes its uuid, then its position. Text that is no number is no posterior.
    """
    rows = raw.select("graph", "pos", F.from_json("json", _NODE).alias("r"))
    kind = node_type(_first("type", "node_type", "payload.type", "metadata.type", "metadata.label", "payload.label"))
    rows = rows.withColumn("key", F.coalesce(*_said("id", "uuid"), F.concat(F.lit("node_"), F.col("pos").cast("string")))).withColumn("kind", kind)
    return rows.select(
        "graph", "pos", F.col("key").alias("id"), F.col("kind").alias("type"), F.coalesce(*_said("label", "name", "payload.name"), F.col("key")).alias("label"),
        _number(_first("posterior", "confidence", "probability", "payload.posterior")).alias("posterior"), F.coalesce(_first("status", "payload.status", "metadata.status"), F.lit("")).alias("status"),
        source_class(_first("source_type", "payload.source_type", "metadata.source_type")).alias("source_type"), _or("asserted", "stance", "payload.stance", "metadata.stance").alias("stance"),
        F.coalesce(_nonempty(_first("layer", "payload.layer", "metadata.layer")), F.col("kind")).alias("layer"),
        F.coalesce(*_said("belief", "payload.belief", "decision", "payload.claim", "label", "name"), F.col("key")).alias("belief_text"),
        _number(_first("payload.trajectory_index", "metadata.trajectory_index")).alias("trajectory_index"),
        F.coalesce(_number(_first("x", "payload.x")), F.lit(0.0)).alias("x"), F.coalesce(_number(_first("y", "payload.y")), F.lit(0.0)).alias("y"),
    )


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def _or(default: str, *paths: str) -> Column:
    return F.coalesce(_nonempty(_first(*paths)), F.lit(default))


def edges(raw: DataFrame) -> DataFrame:
    """graph, pos and an edge's fields; the first of each (source, target, type) of a graph. raw: graph, pos, json."""
    rows = raw.select("graph", "pos", F.from_json("json", _EDGE).alias("r"))
    kind = _first("type", "label", "payload.type", "metadata.type", "payload.relation")
    against = F.lower(F.coalesce(kind, F.lit(""))).rlike("contradict|refute|negative|against")
    back = F.lower(_first("payload.dir", "payload._dir", "metadata.dir")) == "backward"
    rows = rows.select(
        "graph", "pos", F.coalesce(*_said("id", "uuid"), F.concat(F.lit("edge_"), F.col("pos").cast("string"))).alias("id"),
        F.coalesce(*_said("source", "from_id"), F.lit("")).alias("source"), F.coalesce(*_said("target", "to_id"), F.lit("")).alias("target"), relation_type(kind).alias("type"),
        F.when(back, "backward").otherwise("forward").alias("dir"), F.coalesce(_first("note", "payload.note", "metadata.note"), F.lit("")).alias("note"),
        _number(_first("weight", "payload.weight")).alias("weight"), F.when(against, -1).otherwise(1).alias("direction"),
    )
    n = F.row_number().over(Window.partitionBy("graph", "source", "target", "type").orderBy("pos"))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")
