"""Sinks: graph exports, logs, snapshots, results. All writing goes through Spark's committer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_json(df: DataFrame, path: str) -> None:
    """One artifact, replaced as a whole."""
    df.write.mode("overwrite").json(path)


def append_events(df: DataFrame, path: str, kind: str) -> None:
    """Rows as events (ts, event, payload), appended."""
    df.select(F.current_timestamp().alias("ts"), F.lit(kind).alias("event"), F.to_json(F.struct(*df.columns)).alias("payload")).write.mode("append").json(path)


def memory_document(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """item_id, document: beliefs and decisions by id, relations by direction (contradictions look backward), counts."""
    node = F.struct("id", "node_type", "text", "confidence")
    listed = lambda test: F.sort_array(F.collect_list(F.when(test, node)))
    n = nodes.groupBy("item_id").agg(listed(F.col("node_type") != "decision").alias("beliefs"), listed(F.col("node_type") == "decision").alias("decisions"))
    edge = F.struct("id", "from_id", "to_id", "type")
    forward = F.col("type").isin("depends_on", "supplements", "informs")
    r = relations.groupBy("item_id").agg(F.sort_array(F.collect_list(F.when(forward, edge))).alias("forward"), F.sort_array(F.collect_list(F.when(~forward, edge))).alias("backward"))
    joined = n.join(r, "item_id", "left")
    counts = F.struct(F.size("beliefs").alias("beliefs"), F.size("decisions").alias("decisions"), F.coalesce(F.size("forward"), F.lit(0)).alias("forward"), F.coalesce(F.size("backward"), F.lit(0)).alias("backward"))
    return joined.select("item_id", F.to_json(F.struct("beliefs", "decisions", "forward", "backward", counts.alias("counts"))).alias("document"))


def graph_snapshot(nodes: DataFrame, evidence: DataFrame, relations: DataFrame) -> DataFrame:
    """item_id, snapshot: the active nodes, evidence and relations, each by id, and their counts, as one JSON."""
    whole = lambda df: F.sort_array(F.collect_list(F.struct("id", *(c for c in df.columns if c not in ("id", "item_id")))))
    n = nodes.filter(F.coalesce("active", F.lit(True))).groupBy("item_id").agg(whole(nodes).alias("nodes"))
    out = n.join(evidence.groupBy("item_id").agg(whole(evidence).alias("evidence")), "item_id", "left").join(relations.groupBy("item_id").agg(whole(relations).alias("relations")), "item_id", "left")
    counts = F.struct(*(F.coalesce(F.size(c), F.lit(0)).alias(c) for c in ("nodes", "evidence", "relations")))
    return out.select("item_id", F.to_json(F.struct("nodes", "evidence", "relations", counts.alias("counts"))).alias("snapshot"))


def write_artifacts(root: str, nodes: DataFrame, evidence: DataFrame, relations: DataFrame) -> list[str]:
    """A run's outputs, split by kind and direction; the paths written."""
    forward = F.col("type").isin("depends_on", "supplements", "informs")
    parts = {
        "graph": graph_snapshot(nodes, evidence, relations), "memory": memory_document(nodes, relations), "beliefs": nodes.filter("node_type <> 'decision'"), "decisions": nodes.filter("node_type = 'decision'"),
        "evidence": evidence, "relations": relations, "forward": relations.filter(forward), "backward": relations.filter(~forward),
    }
    for name, df in parts.items():
        write_json(df, f"{root}/{name}")
    return [f"{root}/{name}" for name in parts]


def run_paths(root: str, run_id: str) -> dict[str, str]:
    base = f"{root.rstrip('/')}/{run_id}"
    return {k: f"{base}/{k}" for k in ("graph", "memory", "beliefs", "decisions", "evidence", "relations", "forward", "backward", "events", "timing", "trajectory")}


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").partitionBy("benchmark", "mode").json(path)


def timing_csv(timing: DataFrame, path: str) -> None:
    timing.write.mode("overwrite").option("header", True).csv(path)


def step_totals(timing: DataFrame, steps: list[str]) -> DataFrame:
    """step, total, n of a wide timing table."""
    return timing.unpivot([], steps, "step", "seconds").groupBy("step").agg(F.sum("seconds").alias("total"), F.count("seconds").alias("n"))


def dated_root(template: str, now) -> str:
    """An output folder from a template with {Y}, {m}, {d}, {date}; a trailing outputs_M_D rolls over to the given day."""
    import re

    out = template.format(Y=f"{now:%Y}", m=f"{now:%m}", d=f"{now:%d}", date=f"{now:%Y-%m-%d}")
    return re.sub(r"outputs_\d{1,2}_\d{1,2}(?=/?$)", f"outputs_{now.month}_{now.day}", out)
