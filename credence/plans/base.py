"""The engine's tables derived from the driver's, in Spark and - as common table expressions - in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from credence.functions.confidence import prior
from credence.plans.session import table

TURNS_SQL = "turns AS (SELECT CAST(conv_id AS VARCHAR) AS item_id, CAST(turn AS BIGINT) AS turn_id, role, text AS content FROM conversations)"
NODES_SQL = """nodes0 AS (SELECT CAST(conv_id AS VARCHAR) AS item_id, conv_id * 1000 + turn AS id, CAST(turn AS BIGINT) AS turn_id, role, text, length(text) AS len FROM conversations WHERE role <> 'system' AND trim(text) <> ''),
nodes1 AS (SELECT *, CASE len % 4 WHEN 0 THEN 'asserted' WHEN 1 THEN 'recalled' WHEN 2 THEN 'judged' ELSE 'speculated' END AS stance,
  CASE WHEN role = 'assistant' AND len % 3 = 0 THEN 'decision' ELSE 'belief' END AS node_type,
  CASE len % 7 WHEN 0 THEN 'rule_tool_call' WHEN 1 THEN 'rule_tool_result' WHEN 2 THEN 'compact_llm_tool_result' ELSE 'llm' END AS extraction_method,
  CASE WHEN len % 7 = 0 THEN substr(text, 1, 20) END AS query FROM nodes0),
nodes AS (SELECT *, CAST(CASE role || '/' || stance WHEN 'user/asserted' THEN 0.88 WHEN 'user/recalled' THEN 0.78 WHEN 'user/judged' THEN 0.72 WHEN 'user/speculated' THEN 0.58
  WHEN 'assistant/asserted' THEN 0.78 WHEN 'assistant/recalled' THEN 0.68 WHEN 'assistant/judged' THEN 0.65 WHEN 'assistant/speculated' THEN 0.45 ELSE 0.55 END AS DOUBLE) AS confidence, len % 7 = 0 AS procedural FROM nodes1)"""
RELATIONS_SQL = """relations AS (SELECT a.item_id, a.id * 10 + k AS id, a.id AS from_id, b.id AS to_id, CASE (a.len + b.len) % 3 WHEN 0 THEN 'depends_on' WHEN 1 THEN 'supplements' ELSE 'contradicts' END AS type,
  ((a.len + b.len) % 11) / 10.0::DOUBLE AS weight, 0.4::DOUBLE + (a.len % 5) / 20.0::DOUBLE AS threshold
  FROM nodes a CROSS JOIN (SELECT unnest([1, 2]) AS k) JOIN nodes b ON b.item_id = a.item_id AND b.turn_id = a.turn_id - k)"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("item_id"), F.col("turn").cast("long").alias("turn_id"), "role", F.col("text").alias("content"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    rows = table(spark, sf, "conversations").filter("role <> 'system' and trim(text) <> ''").select(
        F.col("conv_id").cast("string").alias("item_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("turn").cast("long").alias("turn_id"), "role", "text", n.cast("long").alias("len"),
        F.when(n % 4 == 0, "asserted").when(n % 4 == 1, "recalled").when(n % 4 == 2, "judged").otherwise("speculated").alias("stance"), F.when((F.col("role") == "assistant") & (n % 3 == 0), "decision").otherwise("belief").alias("node_type"),
        F.when(n % 7 == 0, "rule_tool_call").when(n % 7 == 1, "rule_tool_result").when(n % 7 == 2, "compact_llm_tool_result").otherwise("llm").alias("extraction_method"), F.when(n % 7 == 0, F.substring("text", 1, 20)).alias("query"),
    )
    c = prior(F.col("role"), F.col("stance"))
    return rows.withColumn("confidence", c).withColumn("initial_confidence", c).withColumn("evidence_confidence", F.lit(0.0)).withColumn("factor_confidence", F.lit(0.0)).withColumn("procedural", F.col("len") % 7 == 0)


def relations(spark: SparkSession, sf: str) -> DataFrame:
    a = nodes(spark, sf).select("item_id", "id", "turn_id", "len").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    b = nodes(spark, sf).select("item_id", F.col("id").alias("to_id"), F.col("turn_id").alias("t"), F.col("len").alias("l2"))
    rows = a.withColumn("t", F.col("turn_id") - F.col("k")).join(b, ["item_id", "t"])
    s = F.col("len") + F.col("l2")
    kind = F.when(s % 3 == 0, "depends_on").when(s % 3 == 1, "supplements").otherwise("contradicts")
    return rows.select("item_id", (F.col("id") * 10 + F.col("k")).alias("id"), F.col("id").alias("from_id"), "to_id", kind.alias("type"), ((s % 11) / 10.0).alias("weight"), (0.4 + (F.col("len") % 5) / 20.0).alias("threshold"))


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Usage records of events: label, model, tokens, and a cost that a third of them lack."""
    e = table(spark, sf, "events")
    return e.select(
        F.when(F.col("event_type") == "view", "embedding:nodes").otherwise(F.col("event_type")).alias("label"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), (F.col("event_id") % 1000).alias("input_tokens"),
        (F.col("event_id") % 170).alias("output_tokens"), (F.col("event_id") % 1000 + F.col("event_id") % 170).alias("total_tokens"), (F.col("event_id") % 37).alias("reasoning_tokens"), F.when(F.col("event_id") % 3 != 0, F.floor(F.col("value") * 100) / 1024).alias("cost"), "user_id", "ts", "event_id", "event_type", "value",
    )


USAGE_SQL = """usage AS (SELECT CASE WHEN event_type = 'view' THEN 'embedding:nodes' ELSE event_type END AS label, 'm' || CAST(user_id % 3 AS VARCHAR) AS model, event_id % 1000 AS input_tokens, event_id % 170 AS output_tokens,
  event_id % 1000 + event_id % 170 AS total_tokens, event_id % 37 AS reasoning_tokens, CASE WHEN event_id % 3 <> 0 THEN floor(value * 100) / 1024 END AS cost, user_id, ts, event_id, event_type, value FROM events)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark results of labels: a task for each labelled document."""
    d = F.col("doc_id")
    b = F.when(d % 3 == 0, "gaia").when(d % 3 == 1, "hotpotqa").otherwise("mmlu_pro")
    status = F.when(d % 10 == 0, "timeout").when(d % 10 == 1, "graph_fallback").when(d % 10 == 2, "agent_error").otherwise("completed")
    u = lambda k: F.struct((d % (97 + k)).alias("input"), (d % (53 + k)).alias("output"), (d % 11).alias("cache_read"), (d % 7).alias("cache_write"), (d % (29 + k)).alias("reasoning"), *(((d % (13 + k)) / 64.0).alias(c) for c in ("input_cost", "output_cost", "cache_read_cost", "cache_write_cost", "total_cost")))
    return table(spark, sf, "labels").select(
        d.alias("task"), b.alias("benchmark"), F.when(d % 2 == 0, "graph").otherwise("none").alias("mode"), status.alias("status"), (F.col("quality") == 1).alias("correct"), ((d % 100) / 4.0).alias("wall"), ((d % 16) / 4.0).alias("summary_wall"), (d % 5).alias("search_calls"),
        F.when(d % 4 == 0, d % 6).alias("attempted"), (d % 2).alias("blocked"), (d % 10 == 1).alias("graph_fallback"), F.lit(False).alias("summary_fallback"), F.when(d % 5 != 0, F.col("quality").cast("double")).alias("em"), F.when(d % 5 != 0, (d % 8) / 8.0).alias("f1"),
        u(0).alias("usage"), u(3).alias("graph_usage"), u(6).alias("summary_usage"), F.concat(F.lit("L"), (d % 4).cast("string")).alias("level"),
    )


RESULTS_SQL = """results AS (SELECT doc_id AS task, CASE doc_id % 3 WHEN 0 THEN 'gaia' WHEN 1 THEN 'hotpotqa' ELSE 'mmlu_pro' END AS benchmark, CASE WHEN doc_id % 2 = 0 THEN 'graph' ELSE 'none' END AS mode,
  CASE doc_id % 10 WHEN 0 THEN 'timeout' WHEN 1 THEN 'graph_fallback' WHEN 2 THEN 'agent_error' ELSE 'completed' END AS status, quality = 1 AS correct, (doc_id % 100) / 4.0::DOUBLE AS wall, (doc_id % 16) / 4.0::DOUBLE AS summary_wall, doc_id % 5 AS search_calls,
  CASE WHEN doc_id % 4 = 0 THEN doc_id % 6 END AS attempted, doc_id % 2 AS blocked, doc_id % 10 = 1 AS graph_fallback, CASE WHEN doc_id % 5 <> 0 THEN CAST(quality AS DOUBLE) END AS em, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 8) / 8.0::DOUBLE END AS f1, doc_id AS d, 'L' || CAST(doc_id % 4 AS VARCHAR) AS level, quality FROM labels)"""
