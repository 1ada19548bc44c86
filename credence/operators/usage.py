"""Usage, cost and benchmark aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from credence.functions.usage import estimated_cost, is_embedding

EVALUATED = ("completed", "timeout", "max_tokens", "agent_error", "turn_limit", "score_error")


def count_by(rows: DataFrame, key: Column) -> DataFrame:
    """key, n; null and empty keys count as unknown."""
    return rows.groupBy(F.coalesce(F.nullif(key.cast("string"), F.lit("")), F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"))


def totals(usage: DataFrame, llm_only: bool = False) -> DataFrame:
    rows = usage.filter(~is_embedding(F.col("label"))) if llm_only else usage
    z = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c)
    return rows.agg(z("input_tokens"), z("output_tokens"), z("total_tokens"), z("reasoning_tokens"), F.count("*").alias("calls"))


def by_label(usage: DataFrame) -> DataFrame:
    z = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return usage.groupBy("label").agg(F.count("*").alias("calls"), z("input_tokens"), z("output_tokens"), z("total_tokens"), z("reasoning_tokens"), F.sum("cost").alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced"))


def llm_cost(usage: DataFrame, per_1k_in: float | None = None, per_1k_out: float | None = None) -> DataFrame:
    """cost, source: what providers reported, and an estimate for what they didn't, if prices are configured."""
    rows = usage.filter(~is_embedding(F.col("label")))
    priced = per_1k_in is not None and per_1k_out is not None
    gap = F.when(F.col("cost").isNull(), (F.col("input_tokens") / 1000.0 * (per_1k_in or 0.0) + F.col("output_tokens") / 1000.0 * (per_1k_out or 0.0)) if priced else F.lit(0.0)).otherwise(0.0)
    s = rows.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("reported"), F.coalesce(F.sum(gap), F.lit(0.0)).alias("estimated"), F.count("cost").alias("n_reported"), F.count_if(F.col("cost").isNull()).alias("n_missing"))
    source = F.when((F.col("n_missing") == 0) & (F.col("n_reported") > 0), "provider").when((F.col("n_reported") > 0) & F.lit(priced), "mixed").when((F.col("n_missing") > 0) & F.lit(priced), "configured_pricing").otherwise("unavailable")
    return s.select(F.round(F.col("reported") + F.col("estimated"), 12).alias("cost"), source.alias("source"))


def cost_by_model(usage: DataFrame, per_1k_in: float, per_1k_out: float) -> DataFrame:
    t = usage.groupBy("model").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    return t.select("model", estimated_cost(F.col("i"), F.col("o"), per_1k_in, per_1k_out).alias("cost"))


def cost_breakdown(entries: DataFrame) -> DataFrame:
    """source, cost: by provider/model, other entries as Tools/summaries; nothing at or below 0; dearest first."""
    source = F.when(F.col("kind") == "assistant", F.concat_ws("/", "provider", "model")).otherwise("Tools/summaries")
    return entries.groupBy(source.alias("source")).agg(F.sum("cost").alias("cost")).filter("cost > 0").orderBy(F.desc("cost"), "source")


def model_tokens(results: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint input, reasoning and visible output tokens of agent, graph and summary models, and of all three.

    results: keys, usage, graph_usage, summary_usage (structs input, output, cache_read, cache_write, reasoning). Reasoning is
    part of output, so it is taken off - after summing, and never below 0.
    """
    s = lambda p, c: F.coalesce(F.sum(F.col(f"{p}.{c}")), F.lit(0))
    cols = []
    for name, p, cached in (("agent", "usage", True), ("graph", "graph_usage", False), ("summary", "summary_usage", True)):
        i = s(p, "input") + (s(p, "cache_read") + s(p, "cache_write") if cached else F.lit(0))
        cols += [i.alias(f"{name}_input"), s(p, "reasoning").alias(f"{name}_reasoning"), F.greatest(F.lit(0), s(p, "output") - s(p, "reasoning")).alias(f"{name}_output")]
    rows = results.groupBy(*keys).agg(*cols)
    for c in ("input", "reasoning", "output"):
        rows = rows.withColumn(f"combined_{c}", sum((F.col(f"{n}_{c}") for n in ("graph", "summary")), F.col(f"agent_{c}")))
    return rows


def model_cost(results: DataFrame, keys: list[str]) -> DataFrame:
    parts = ("input_cost", "output_cost", "cache_read_cost", "cache_write_cost", "total_cost")
    return results.groupBy(*keys).agg(*(F.coalesce(F.sum(F.col(f"{p}.{c}")), F.lit(0.0)).alias(f"{n}_{c}") for n, p in (("agent", "usage"), ("graph", "graph_usage"), ("summary", "summary_usage")) for c in parts))


def summary(results: DataFrame) -> DataFrame:
    """A row for each benchmark and mode. Accuracy is over evaluated statuses, so what fell back isn't counted.

    results: benchmark, mode, status, correct, wall, summary_wall, search_calls, attempted, blocked, graph_fallback,
    summary_fallback, em, f1.
    """
    done, judged = F.col("status") == "completed", F.col("status").isin(*EVALUATED)
    right = F.coalesce("correct", F.lit(False))
    calls = F.coalesce("search_calls", F.lit(0))
    grouped = results.groupBy("benchmark", "mode").agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(judged).alias("evaluated"), F.count_if(judged & right).alias("correct"), F.count_if(done & right).alias("completed_correct"),
        F.count_if(F.coalesce("graph_fallback", F.lit(False))).alias("graph_fallbacks"), F.count_if(F.coalesce("summary_fallback", F.lit(False))).alias("summary_fallbacks"),
        F.sum(F.coalesce("wall", F.lit(0.0))).alias("wall_total"), F.avg(F.coalesce("wall", F.lit(0.0))).alias("wall_mean"), F.avg(F.greatest(F.lit(0.0), F.coalesce("wall", F.lit(0.0)) - F.coalesce("summary_wall", F.lit(0.0)))).alias("agent_wall_mean"),
        F.sum(calls).alias("search_calls_total"), F.avg(calls).alias("search_calls_mean"), F.sum(F.coalesce("attempted", calls)).alias("attempted_total"), F.sum(F.coalesce("blocked", F.lit(0))).alias("blocked_total"),
        F.coalesce(F.avg(F.when(done, F.col("em"))), F.lit(0.0)).alias("exact_match"), F.coalesce(F.avg(F.when(done, F.col("f1"))), F.lit(0.0)).alias("f1"),
    )
    return grouped.withColumn("accuracy", F.when(F.col("evaluated") > 0, F.col("correct") / F.col("evaluated"))).withColumn("completed_only_accuracy", F.when(F.col("completed") > 0, F.col("completed_correct") / F.col("completed"))).drop("completed_correct")


def status_counts(results: DataFrame) -> DataFrame:
    """benchmark, mode, counts (a map)."""
    return results.groupBy("benchmark", "mode", "status").count().groupBy("benchmark", "mode").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "count")))).alias("counts"))


def group_accuracy(results: DataFrame, key: Column) -> DataFrame:
    """name, total, correct, accuracy of evaluated rows whose key isn't null."""
    rows = results.filter(F.col("status").isin(*EVALUATED)).withColumn("name", key.cast("string")).filter("name is not null")
    right = F.count_if(F.coalesce("correct", F.lit(False)))
    return rows.groupBy("name").agg(F.count("*").alias("total"), right.alias("correct"), (right / F.count("*")).alias("accuracy")).orderBy("name")


def agent_events(events: DataFrame) -> DataFrame:
    """task, final_response, stop_reason, input, output, n_assistant: a fold over a task's events.

    events: task, seq, type, role, text, stop_reason, input, output. The last text that isn't blank and the last stop reason win.
    """
    msg = (F.col("type") == "message_end") & (F.col("role") == "assistant")
    text = F.when(msg & (F.trim(F.coalesce("text", F.lit(""))) != ""), F.col("seq"))
    stop = F.when(msg & (F.coalesce("stop_reason", F.lit("")) != ""), F.col("seq"))
    z = lambda c: F.coalesce(F.sum(F.when(msg, F.coalesce(c, F.lit(0)))), F.lit(0)).alias(c)
    return events.groupBy("task").agg(F.trim(F.max_by("text", text)).alias("final_response"), F.max_by("stop_reason", stop).alias("stop_reason"), z("input"), z("output"), F.count_if(msg).alias("n_assistant"))


def tool_counts(events: DataFrame) -> DataFrame:
    """task, calls, blocked: maps of counts by tool."""
    name = F.coalesce("tool", F.lit("unknown"))
    per = events.withColumn("tool", name).groupBy("task", "tool").agg(F.count_if(F.col("type") == "tool_execution_start").alias("calls"), F.count_if((F.col("role") == "toolResult") & F.coalesce("is_blocked", F.lit(False))).alias("blocked"))
    m = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.struct("tool", c))))).alias(c)
    return per.groupBy("task").agg(m("calls"), m("blocked"))


def strategy_means(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """strategy, metric, mean, n over the values that aren't null."""
    return rows.unpivot(["strategy"], metrics, "metric", "value").groupBy("strategy", "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def cumulative_means(calls: DataFrame, horizon: int) -> DataFrame:
    """call, mean: the mean over tasks of tokens used up to each call; tasks that end early keep their last sum.

    calls: task, seq (from 1), tokens. No task-by-call grid is made: a task adds its increments and stays.
    """
    n = calls.select("task").distinct().count()
    steps = calls.filter(F.col("seq") <= horizon).groupBy("seq").agg(F.sum("tokens").alias("t"))
    grid = calls.sparkSession.range(1, horizon + 1).select(F.col("id").cast("int").alias("call"))
    joined = grid.join(steps, F.col("call") == F.col("seq"), "left")
    run = F.sum(F.coalesce("t", F.lit(0))).over(Window.orderBy("call"))  # `horizon` rows
    return joined.select("call", (run / F.lit(max(1, n))).alias("mean"))


def break_even(a: DataFrame, b: DataFrame) -> DataFrame:
    """call: where the first curve meets the second, between calls by linear interpolation; no row if never. Curves: call, mean."""
    d = a.select("call", F.col("mean").alias("x")).join(b.select("call", F.col("mean").alias("y")), "call").withColumn("d", F.col("x") - F.col("y"))
    w = Window.orderBy("call")
    d = d.withColumn("p", F.lag("d").over(w)).withColumn("c0", F.lag("call").over(w))
    cross = d.filter("p is not null and ((p < 0 and d >= 0) or (p > 0 and d <= 0))")
    return cross.orderBy("call").limit(1).select((F.col("c0") + (F.col("call") - F.col("c0")) * F.abs("p") / (F.abs("p") + F.abs("d"))).alias("call"))


def paired_outcomes(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_correct, b_correct, n: the two-by-two table of two runs of the same tasks."""
    return a.select("task", F.col("correct").alias("a_correct")).join(b.select("task", F.col("correct").alias("b_correct")), "task").groupBy("a_correct", "b_correct").agg(F.count("*").alias("n"))


def paired_tasks(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """task, and for each metric both values and their difference."""
    rows = a.select("task", *(F.col(m).alias(f"a_{m}") for m in metrics)).join(b.select("task", *(F.col(m).alias(f"b_{m}") for m in metrics)), "task")
    return rows.select("task", *(x for m in metrics for x in (f"a_{m}", f"b_{m}", (F.col(f"b_{m}") - F.col(f"a_{m}")).alias(f"d_{m}"))))


def session_info(entries: DataFrame) -> DataFrame:
    """session, name, messages, last_activity, first_message, all_text of session files."""
    user = F.col("role") == "user"
    return entries.groupBy("session").agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name"), F.count_if(F.col("role").isNotNull()).alias("messages"), F.max("ts").alias("last_activity"), F.min_by("text", F.when(user, F.col("seq"))).alias("first_message"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role").isin("user", "assistant"), F.struct("seq", "text")))), lambda x: x["text"]), " ").alias("all_text"),
    )


def dashboard_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """item_id, counts by type, mean posterior (null as 0), edges."""
    n = nodes.groupBy("item_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("node_type") == "belief").alias("beliefs"), F.count_if(F.col("node_type") == "decision").alias("decisions"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("mean_posterior"))
    e = edges.groupBy("item_id").agg(F.count("*").alias("edges"), F.count_if(F.col("type") == "contradicts").alias("contradictions"))
    return n.join(e, "item_id", "left").na.fill(0, ["edges", "contradictions"])


def interleaved(tasks: DataFrame, modes: list[str]) -> DataFrame:
    """Work in turn over benchmarks, then modes: position, benchmark, task_id, mode."""
    w = Window.partitionBy("benchmark").orderBy("task_id")
    m = F.explode(F.array(*(F.struct(F.lit(i).alias("mode_at"), F.lit(x).alias("mode")) for i, x in enumerate(modes)))).alias("m")
    rows = tasks.withColumn("n", F.row_number().over(w)).select("benchmark", "task_id", "n", m).select("benchmark", "task_id", "n", "m.*")
    return rows.orderBy("n", "benchmark", "mode_at").select("n", "benchmark", "task_id", "mode")


def scored(tasks: DataFrame) -> DataFrame:
    """task_id, correct, score, extracted by each benchmark's rule. tasks: task_id, benchmark, response, answers.

    An answer a row, then the best of each task. Benchmarks without a rule are an error.
    """
    from credence.functions import scoring as S

    known = F.col("benchmark").isin("gaia", "hotpotqa", "mmlu_pro")
    rows = tasks.withColumn("benchmark", F.when(known, F.col("benchmark")).otherwise(F.raise_error(F.concat(F.lit("no scorer: "), F.col("benchmark")))))
    rows = rows.withColumn("final", S.final_answer(F.col("response"))).withColumn("choice", S.multiple_choice(F.col("response")))
    one = rows.select("task_id", "benchmark", "final", "choice", F.explode_outer("answers").alias("answer")).withColumn("hp", S.hotpot(F.col("final"), F.col("answer"))).withColumn("ga", S.gaia_match(F.col("final"), F.col("answer")))
    ok = F.when(F.col("benchmark") == "hotpotqa", F.col("hp.exact_match") > 0).when(F.col("benchmark") == "mmlu_pro", F.upper(F.trim("answer")) == F.col("choice")).otherwise(F.col("ga"))
    value = F.when(F.col("benchmark") == "hotpotqa", F.col("hp.f1")).otherwise(ok.cast("double"))
    extracted = F.when(F.col("benchmark") == "mmlu_pro", F.col("choice")).otherwise(F.col("final"))
    return one.groupBy("task_id").agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("correct"), F.coalesce(F.max(value), F.lit(0.0)).alias("score"), F.first(extracted).alias("extracted"))


def axes(rows: DataFrame, panel: str, value: str) -> DataFrame:
    """panel, top, step, ticks: an axis from 0 with round steps, about seven, that leaves 8 % above the greatest value."""
    high = rows.groupBy(panel).agg(F.max(value).alias("high")).filter("high > 0")
    room = F.col("high") * 1.08
    power = F.pow(F.lit(10.0), F.floor(F.log10(room / 7)))
    # The least of these multiples that is wide enough.
    step = F.element_at(F.filter(F.array(*(F.lit(m) for m in (1.0, 2.0, 2.5, 5.0, 10.0))), lambda m: room / 7 / power <= m), 1) * power
    out = high.withColumn("step", step).withColumn("top", F.ceil(room / F.col("step")) * F.col("step"))
    ticks = F.transform(F.sequence(F.lit(0), F.round(F.col("top") / F.col("step")).cast("int")), lambda k: k * F.col("step"))
    return out.select(panel, "top", "step", ticks.alias("ticks"))
