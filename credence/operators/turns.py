"""Turns: roles, what is skipped, fragments put together, islands and windows of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from credence.functions.confidence import norm_role


def numbered(turns: DataFrame) -> DataFrame:
    """turn_id by arrival within the item, given before anything is filtered: skipped turns leave gaps."""
    w = Window.partitionBy("item_id").orderBy("recv_index")
    return turns.withColumn("turn_id", (F.row_number().over(w) - 1).cast("long"))


def kept(turns: DataFrame, min_chars: int = 1) -> DataFrame:
    """Turns that are read: of a user, an assistant or a tool, not blank, not too short."""
    role = norm_role(F.col("role"))
    text = F.trim(F.coalesce("content", F.lit("")))
    return turns.withColumn("role", role).filter(role.isin("user", "assistant", "tool") & (text != "") & (F.length(text) >= min_chars))


def assembled(fragments: DataFrame) -> DataFrame:
    """Messages of fragments: one ends where is_message_end (default true) or is_trajectory_end holds, or the role changes.

    problem_id, message, role (of the last fragment), content, n_fragments.
    """
    w = Window.partitionBy("problem_id").orderBy("recv_index")
    end = F.coalesce("is_message_end", F.lit(True)) | F.coalesce("is_trajectory_end", F.lit(False))
    rows = fragments.withColumn("role", norm_role(F.col("role"))).withColumn("ends", end)
    new = F.coalesce(F.lag("ends").over(w), F.lit(True)) | (F.lag("role").over(w) != F.col("role"))
    rows = rows.withColumn("message", F.sum(new.cast("int")).over(w))
    return rows.groupBy("problem_id", "message").agg(F.max_by("role", "recv_index").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("recv_index", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), "").alias("content"), F.count("*").alias("n_fragments"))


def turn_islands(messages: DataFrame) -> DataFrame:
    """island: a new one starts at each user message, and at an assistant message if the running one has an assistant.

    With k the running number of user messages, an island of k starts anew at each of its assistants but the first.
    """
    w = Window.partitionBy("item_id").orderBy("seq")
    rows = messages.withColumn("users", F.sum((F.col("role") == "user").cast("int")).over(w))
    nth = F.sum((F.col("role") == "assistant").cast("int")).over(Window.partitionBy("item_id", "users").orderBy("seq"))
    rows = rows.withColumn("nth", nth)
    starts = (F.col("role") == "user") | ((F.col("role") == "assistant") & (F.col("nth") > 1)) | F.lag("seq").over(w).isNull()
    return rows.withColumn("island", F.sum(starts.cast("int")).over(w)).drop("users", "nth")


def recent_islands(islands: DataFrame, n: int) -> DataFrame:
    """retained: whether an island is among the last n with an assistant, or open after them. Negative n keeps all."""
    if n < 0:
        return islands.withColumn("retained", F.lit(True))
    has = islands.groupBy("item_id", "island").agg(F.bool_or(F.col("role") == "assistant").alias("done"))
    w = Window.partitionBy("item_id").orderBy(F.desc("island"))
    later = F.sum(F.col("done").cast("int")).over(w)
    flags = has.select("item_id", "island", ((later <= n) & (F.col("done") | (later == 0) | (later <= n))).alias("retained"))
    # An open island before n complete ones have been seen is retained; one beyond them isn't.
    return islands.join(flags, ["item_id", "island"])


def history_window(nodes: DataFrame, n: int) -> DataFrame:
    """Nodes of an item's last n distinct turns; all if n <= 0."""
    if n <= 0:
        return nodes
    rank = F.dense_rank().over(Window.partitionBy("item_id").orderBy(F.desc("turn_id")))
    return nodes.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def previous_layers(nodes: DataFrame, k: int = 3) -> DataFrame:
    """Pairs (item_id, id, prev_id, distance) of a node with those of the up to k non-empty turns before its own."""
    layer = F.dense_rank().over(Window.partitionBy("item_id").orderBy("turn_id"))
    rows = nodes.select("item_id", "id", layer.alias("layer"))
    # A range of k layers is k equalities: the join stays a hash join on (item, layer).
    ahead = rows.select("item_id", F.col("id").alias("prev_id"), F.explode(F.sequence(F.col("layer") + 1, F.col("layer") + k)).alias("layer"), F.col("layer").alias("prev_layer"))
    return rows.join(ahead, ["item_id", "layer"]).select("item_id", "id", "prev_id", (F.col("layer") - F.col("prev_layer")).alias("distance"))


def latest_call_turn(turns: DataFrame) -> DataFrame:
    """call_turn: for each turn the last earlier one that holds calls (an as-of lookup by a window, no join)."""
    w = Window.partitionBy("item_id").orderBy("turn_id").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("call_turn", F.last(F.when(F.col("n_calls") > 0, F.col("turn_id")), ignorenulls=True).over(w))


def paired_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """item_id, result_id, call_id: by exact tool_call_id, else by place in the last call turn, clamped to its last call.

    calls: item_id, turn_id, call_index, tool_call_id, call_id; results: item_id, turn_id, result_index, tool_call_id, result_id.
    """
    exact = results.join(calls.filter("tool_call_id is not null").select("item_id", "tool_call_id", F.col("call_id").alias("exact_id")), ["item_id", "tool_call_id"], "left").groupBy("item_id", "result_id", "turn_id", "result_index").agg(F.min("exact_id").alias("exact_id"))
    per_turn = calls.groupBy("item_id", "turn_id").agg(F.array_sort(F.collect_list(F.struct("call_index", "call_id"))).alias("in_turn"))
    events = exact.select("item_id", "turn_id", F.lit(1).alias("kind"), "result_id", "result_index", "exact_id", F.lit(None).cast(per_turn.schema["in_turn"].dataType).alias("in_turn")).unionByName(
        per_turn.select("item_id", "turn_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("result_id"), F.lit(None).cast("long").alias("result_index"), F.lit(None).cast("long").alias("exact_id"), "in_turn"))
    w = Window.partitionBy("item_id").orderBy("turn_id", "kind", "result_index").rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("last_calls", F.last("in_turn", ignorenulls=True).over(w)).filter("kind = 1")
    place = F.least(F.col("result_index"), F.size("last_calls") - 1)
    return seen.select("item_id", "result_id", F.coalesce("exact_id", F.get("last_calls", place.cast("int"))["call_id"]).alias("call_id"))


def result_queries(pairs: DataFrame, calls: DataFrame) -> DataFrame:
    """item_id, result_id, query: the query of the call that a result answers; null where it has none or a blank one.

    pairs: as `paired_results` gives them; calls: item_id, call_id, query.
    """
    q = calls.select("item_id", "call_id", F.when(F.trim("query") != "", F.col("query")).alias("query"))
    return pairs.join(q, ["item_id", "call_id"], "left").select("item_id", "result_id", "query")


def recent_steps(steps: DataFrame, n: int) -> DataFrame:
    """The last n complete steps of a session and all that follows; calls of one batch stay whole.

    steps: session, seq, batch (equal for parallel calls), complete.
    """
    whole = steps.groupBy("session", "batch").agg(F.min("seq").alias("first"), F.bool_and("complete").alias("done"))
    w = Window.partitionBy("session").orderBy(F.desc("first"))
    ranked = whole.withColumn("later", F.sum(F.col("done").cast("int")).over(w))
    keep = ranked.filter(F.col("later") <= n).select("session", "batch")
    return steps.join(keep, ["session", "batch"], "left_semi")


def cut_point(entries: DataFrame, keep_tokens: int) -> DataFrame:
    """session, cut: the first entry that is kept when the newest entries hold keep_tokens, moved on to the next valid place.

    entries: session, seq, tokens, is_cut (where a cut may fall). Without such a place, the first entry.
    """
    back = Window.partitionBy("session").orderBy(F.desc("seq"))
    rows = entries.withColumn("held", F.sum("tokens").over(back))
    over = rows.filter((F.col("held") >= keep_tokens) & (F.col("tokens") > 0)).groupBy("session").agg(F.max("seq").alias("at"))
    cuts = entries.groupBy("session").agg(F.min("seq").alias("start"), F.min(F.when(F.col("is_cut"), F.col("seq"))).alias("first_cut"))
    next_cut = entries.filter("is_cut").join(over, "session").filter(F.col("seq") >= F.col("at")).groupBy("session").agg(F.min("seq").alias("next_cut"))
    return cuts.join(next_cut, "session", "left").select("session", F.coalesce("next_cut", "first_cut", "start").alias("cut"))


def cache_misses(messages: DataFrame, noise_floor: int = 1024) -> DataFrame:
    """Misses of the prompt cache: session, seq, missed_tokens, idle, model_changed.

    messages: session, seq, kind ('message', else a reset), model, input, cache_read, cache_write, ts. A request is
    compared with the one before it since the last reset; one without cache activity counts only if some was reported before.
    """
    w = Window.partitionBy("session").orderBy("seq")
    rows = messages.withColumn("segment", F.sum((F.col("kind") != "message").cast("int")).over(w)).filter("kind = 'message'")
    rows = rows.withColumn("prompt", F.col("input") + F.col("cache_read") + F.col("cache_write")).filter("prompt > 0")
    s = Window.partitionBy("session", "segment").orderBy("seq")
    active = (F.col("cache_read") + F.col("cache_write") > 0).cast("int")
    rows = rows.withColumn("prev", F.lag("prompt").over(s)).withColumn("prev_model", F.lag("model").over(s)).withColumn("prev_ts", F.lag("ts").over(s))
    rows = rows.withColumn("reported", F.max(active).over(s.rowsBetween(Window.unboundedPreceding, -1)))
    missed = F.least("prev", "prompt") - F.col("cache_read")
    counts = F.col("prev").isNotNull() & ((active == 1) | (F.col("reported") == 1)) & (missed > noise_floor)
    return rows.filter(counts).select("session", "seq", missed.alias("missed_tokens"), F.greatest(F.lit(0), F.col("ts") - F.col("prev_ts")).alias("idle"), (F.col("model") != F.col("prev_model")).alias("model_changed"))


def repeated_queries(queries: DataFrame, threshold: float = 0.72) -> DataFrame:
    """task, repeated: queries that resemble an earlier one of their task (Jaccard of tokens)."""
    from credence.functions.text import words
    from credence.operators.sets import like_an_earlier_one

    rows = queries.select(F.col("task").alias("block"), "seq", F.array_distinct(words(F.col("query"))).alias("t"))
    hits = like_an_earlier_one(rows, threshold).withColumnRenamed("block", "task")
    return queries.select("task").distinct().join(hits.groupBy("task").agg(F.count("*").alias("repeated")), "task", "left").select("task", F.coalesce("repeated", F.lit(0)).alias("repeated"))


def first_call(rows: DataFrame, hit: Column) -> DataFrame:
    """task, first: the 1-based place of the first row that meets `hit`."""
    n = F.row_number().over(Window.partitionBy("task").orderBy("seq"))
    return rows.withColumn("__n", n).filter(hit).groupBy("task").agg(F.min("__n").alias("first"))
