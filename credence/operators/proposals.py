"""The boundary to models: their outputs are tables of proposals, checked here. Nothing in this engine calls a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from credence.functions import toolwire as T
from credence.schema import RELATION_TYPES, STANCES

NODE = "struct<tmp_id:string,text:string,stance:string,entities:array<string>,sentence_indices:array<int>,node_type:string>"


def recorded(requests: DataFrame, answers: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Requests with the answers on record; requests without one have a null answer. Stands where a model would."""
    last = answers.groupBy(key).agg(F.max_by("answer", "attempt").alias("answer"), F.max("attempt").alias("attempts"))
    return requests.join(last, key, "left")


def with_model(rows: DataFrame, udf, prompt: str, out: str = "answer") -> DataFrame:
    """Any Arrow UDF as the model: equal prompts are asked once."""
    asked = rows.select(prompt).distinct().withColumn(out, udf(F.col(prompt)))
    return rows.join(asked, prompt, "left")


def valid_nodes(answers: DataFrame) -> DataFrame:
    """Nodes of JSON answers (an array): with a text and a known stance (else asserted), sentence numbers within the turn.

    answers: item_id, turn_id, n_sentences, answer.
    """
    rows = answers.select("item_id", "turn_id", "n_sentences", F.posexplode(F.from_json("answer", f"array<{NODE}>")).alias("ordinal", "n"))
    text = F.trim("n.text")
    stance = F.lower(F.trim("n.stance"))
    inside = F.filter(F.coalesce("n.sentence_indices", F.array().cast("array<int>")), lambda i: (i >= 0) & (i < F.col("n_sentences")))
    out = rows.select(
        "item_id", "turn_id", "ordinal", F.coalesce("n.tmp_id", F.concat(F.lit("n"), F.col("ordinal").cast("string"))).alias("tmp_id"), text.alias("text"), F.when(stance.isin(*STANCES), stance).otherwise("asserted").alias("stance"),
        F.array_distinct(F.filter(F.transform(F.coalesce("n.entities", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda e: e != "")).alias("entities"), F.array_sort(F.array_distinct(inside)).alias("sentence_indices"),
        F.when(F.col("n.node_type") == "decision", "decision").otherwise("belief").alias("node_type"),
    )
    return out.filter("text <> ''")


def numbered(nodes: DataFrame, last_ids: DataFrame) -> DataFrame:
    """id: numbers after the item's last one, by turn and ordinal. last_ids: item_id, last_id."""
    n = F.row_number().over(Window.partitionBy("item_id").orderBy("turn_id", "ordinal"))
    return nodes.join(last_ids, "item_id", "left").withColumn("id", F.coalesce("last_id", F.lit(-1)) + n).drop("last_id")


def rule_call_nodes(turns: DataFrame) -> DataFrame:
    """A node for each tool call of a turn; no model. item_id, turn_id, call_index, tool_call_id, tool_name, query, text, extraction_method."""
    c = turns.select("item_id", "turn_id", F.posexplode(T.tool_calls(F.col("content"))).alias("call_index", "c"))
    return c.select(
        "item_id", "turn_id", "call_index", F.col("c.id").alias("tool_call_id"), F.col("c.name").alias("tool_name"), F.col("c.query").alias("query"), F.col("c.arguments").alias("tool_arguments"),
        T.call_belief(F.col("c.name"), F.col("c.query"), F.col("c.arguments")).alias("text"), F.lit("rule_tool_call").alias("extraction_method"), F.lit("asserted").alias("stance"),
    )


def rule_result_nodes(turns: DataFrame, max_results: int = 3, max_snippet_chars: int = 280) -> DataFrame:
    """A node for each tool result; no model, stance recalled."""
    one = F.when(F.size(T.tool_results(F.col("content"))) > 0, T.tool_results(F.col("content"))).otherwise(F.array_compact(F.array(T.tool_result(F.col("content")))))
    r = turns.select("item_id", "turn_id", F.posexplode(one).alias("result_index", "r"))
    body = T.observation_body(F.col("r.body"), F.col("r.is_error"))
    r = r.select("item_id", "turn_id", "result_index", F.col("r.tool_name").alias("tool_name"), F.col("r.tool_call_id").alias("tool_call_id"), F.col("r.is_error").alias("is_error"), body.alias("body"))
    r = r.withColumn("items", T.search_items(F.col("body"))).withColumn("c", T.compact_result(F.col("tool_name"), F.col("body"), F.col("items"), max_results, max_snippet_chars))
    return r.select("item_id", "turn_id", "result_index", "tool_name", "tool_call_id", "is_error", F.col("c.text").alias("text"), F.col("c.items").alias("tool_result_items"), F.col("c.entities").alias("entities"), F.lit("rule_tool_result").alias("extraction_method"), F.lit("recalled").alias("stance"))


def completed_calls(rule_nodes: DataFrame, model_nodes: DataFrame) -> DataFrame:
    """Exactly one node for each call: the model's wording where it gave one, the rule's metadata always."""
    m = model_nodes.select("item_id", "turn_id", "call_index", F.col("text").alias("model_text")).withColumn("n", F.row_number().over(Window.partitionBy("item_id", "turn_id", "call_index").orderBy("model_text"))).filter("n = 1").drop("n")
    return rule_nodes.join(m, ["item_id", "turn_id", "call_index"], "left").withColumn("text", F.coalesce(F.nullif(F.trim("model_text"), F.lit("")), F.col("text"))).drop("model_text")


def result_fallback(facts: DataFrame, rule_nodes: DataFrame, most: int = 3) -> DataFrame:
    """Up to `most` facts for each result; the rule's node for results without any. facts: item_id, turn_id, result_index, ordinal, text."""
    n = F.row_number().over(Window.partitionBy("item_id", "turn_id", "result_index").orderBy("ordinal"))
    ok = facts.filter("trim(text) <> ''").withColumn("n", n).filter(F.col("n") <= most).select("item_id", "turn_id", "result_index", (F.col("n") - 1).alias("fact_index"), "text", F.lit("compact_llm_tool_result").alias("extraction_method"))
    rest = rule_nodes.join(ok, ["item_id", "turn_id", "result_index"], "left_anti").select("item_id", "turn_id", "result_index", F.lit(0).alias("fact_index"), "text", "extraction_method")
    return ok.unionByName(rest)


def valid_relations(raw: DataFrame) -> DataFrame:
    """Proposed relations of known types with two ends. raw: item_id, answer (a JSON array)."""
    rows = raw.select("item_id", F.posexplode(F.from_json("answer", "array<struct<from:string,to:string,from_id:string,to_id:string,type:string,note:string>>")).alias("ordinal", "r"))
    a, b = F.coalesce("r.from", "r.from_id"), F.coalesce("r.to", "r.to_id")
    return rows.select("item_id", "ordinal", a.alias("from_ref"), b.alias("to_ref"), F.lower(F.trim("r.type")).alias("type"), F.col("r.note").alias("note")).filter(F.col("type").isin(*RELATION_TYPES) & a.isNotNull() & b.isNotNull())


def argmax_label(scores: Column, labels: list[str]) -> Column:
    """The label of the highest score; of equals the earlier one."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(scores, F.array_max(scores)).cast("int"))


def folded_summary(evicted: DataFrame, most_chars: int = 2000) -> DataFrame:
    """session, summary: evicted turns folded in order into one bounded summary; stands where a model would condense."""
    g = evicted.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("t"))
    step = lambda s, x: F.substring(F.concat_ws("\n", F.nullif(s, F.lit("")), F.substring(F.trim(x["text"]), 1, 200)), -most_chars, most_chars)
    return g.select("session", F.aggregate("t", F.lit(""), step).alias("summary"))
