"""Retrieval: inverted-index BM25, similarity by units, constraint coverage, answer metrics, chunk breaks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from credence.functions import text as X

K1, B = 1.2, 0.75


#: Query terms that are broadcast; beyond that they join by shuffles.
MOST_TERMS = 200_000


def bm25(docs: DataFrame, queries: DataFrame, top: int = 6, most_terms: int = MOST_TERMS) -> DataFrame:
    """query_id, doc_id, score, rank: the best `top` of each query; ties to the newer turn, then the smaller id.

    docs: doc_id, turn, text; queries: query_id, text. One pass cuts the texts and keeps the postings of query terms
    alone; they are written down, as document frequencies and scores both need them. The terms of a counted, bounded set
    of queries are broadcast, so a common word is a key of no shuffle; what follows is keyed by document and query.
    """
    from credence.operators.graph import cut

    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(X.TOKEN), F.lit(0))
    rows = docs.select("doc_id", "turn", tokens.alias("tokens")).withColumn("len", F.size("tokens"))
    whole = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))  # one row
    wanted = cut(queries.select("query_id", F.explode(X.tokens(F.col("text"))).alias("term")), "terms")
    sent = F.broadcast if wanted.count() <= most_terms else (lambda df: df)
    hits = rows.select("doc_id", "turn", "len", F.explode("tokens").alias("term")).join(sent(wanted.select("term").distinct()), "term", "left_semi")
    hits = cut(hits.groupBy("doc_id", "turn", "len", "term").agg(F.count("*").alias("tf")), "postings")
    df = hits.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(whole))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = wanted.join(df, "term").select("query_id", "term", idf.alias("idf"), "avg_len")
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scores = hits.join(sent(asked), "term").groupBy("query_id", "doc_id", "turn").agg(F.round(F.sum(gain), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("turn"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", "doc_id", "turn", "score", "rank")


def units(nodes: DataFrame) -> DataFrame:
    """item_id, id, unit: a node's text, and the title and snippet of each of its results."""
    items = F.transform(F.coalesce("tool_result_items", F.array().cast("array<struct<title:string,snippet:string>>")), lambda r: F.array_join(F.filter(F.array(F.trim(r["title"]), F.trim(r["snippet"])), lambda x: F.coalesce(x != "", F.lit(False))), " — "))
    return nodes.select("item_id", "id", F.explode(F.filter(F.concat(F.array(F.trim("text")), items), lambda u: u != "")).alias("unit"))


def similarities(unit_rows: DataFrame, queries: DataFrame) -> DataFrame:
    """item_id, id, query, similarity: the best lexical similarity of a node's units to each query of its item.

    queries: item_id, query, text. Joined on the item: never a product of all.
    """
    q = queries.select("item_id", "query", X.tokens(F.col("text")).alias("q"))
    u = unit_rows.select("item_id", "id", X.tokens(F.col("unit")).alias("u"))
    return u.join(q, "item_id").groupBy("item_id", "id", "query").agg(F.max(X.set_cosine(F.col("q"), F.col("u"))).alias("similarity"))


def coverage(selected: DataFrame, scores: DataFrame) -> DataFrame:
    """item_id, constraint, ratio: how far a selection covers each constraint, of the best that any node does.

    scores: item_id, id, constraint, similarity.
    """
    best = scores.groupBy("item_id", "constraint").agg(F.max(F.greatest(F.lit(0.0), "similarity")).alias("best"))
    mine = scores.join(selected.select("item_id", "id"), ["item_id", "id"], "left_semi").groupBy("item_id", "constraint").agg(F.max(F.greatest(F.lit(0.0), "similarity")).alias("mine"))
    ratio = F.least(F.lit(1.0), F.coalesce("mine", F.lit(0.0)) / F.greatest(F.lit(0.08), "best"))
    return best.join(mine, ["item_id", "constraint"], "left").select("item_id", "constraint", ratio.alias("ratio"))


def answer_nodes(nodes: DataFrame, tasks: DataFrame, source_grounded: bool = False) -> DataFrame:
    """item_id, id of nodes that hold the answer. tasks: item_id, answer, question."""
    grounded = F.col("role").isin("tool", "function") | F.coalesce(F.col("extraction_method").isin("compact_llm_tool_result", "rule_tool_result"), F.lit(False))
    rows = nodes.filter(grounded) if source_grounded else nodes
    return rows.join(tasks, "item_id").filter(X.bears_answer(F.col("text"), F.col("answer"), F.col("question"))).select("item_id", "id")


def selection_metrics(selected: DataFrame, answers: DataFrame, support: DataFrame, relations: DataFrame) -> DataFrame:
    """item_id, strategy: size, chars, answer recall, support recall, first answer's place, relations.

    selected: strategy, item_id, id, pos, cost; answers, support: item_id, id.
    """

    a = answers.select("item_id", "id").distinct().withColumn("a", F.lit(True))
    s = support.select("item_id", "id").distinct().withColumn("s", F.lit(True))
    flags = selected.join(a, ["item_id", "id"], "left").join(s, ["item_id", "id"], "left")
    n = lambda df, c: df.groupBy("item_id").agg(F.count("*").alias(c))
    out = flags.groupBy("strategy", "item_id").agg(F.count("*").alias("nodes"), F.sum("cost").alias("chars"), F.count("a").alias("answers_hit"), F.count("s").alias("support_hit"), F.min(F.when(F.col("a"), F.col("pos"))).alias("first_answer"))
    out = out.join(n(a, "answers"), "item_id", "left").join(n(s, "support"), "item_id", "left")
    recall = lambda h, t: F.when(F.coalesce(t, F.lit(0)) > 0, F.col(h) / F.col(t))
    # The relations of each strategy's selection, all strategies in one join.
    ends = lambda c: selected.select("strategy", "item_id", F.col("id").alias(c)).distinct()
    within = relations.join(ends("from_id"), ["item_id", "from_id"]).join(ends("to_id"), ["strategy", "item_id", "to_id"])
    out = out.join(within.groupBy("item_id", "strategy").agg(F.count("*").alias("relations")), ["item_id", "strategy"], "left")
    return out.select("strategy", "item_id", "nodes", "chars", recall("answers_hit", "answers").alias("answer_recall"), recall("support_hit", "support").alias("support_recall"), "first_answer", F.coalesce("relations", F.lit(0)).alias("relations"))


def buffered(sentences: DataFrame, buffer: int = 1) -> DataFrame:
    """window_text: each sentence with its neighbours. sentences: text_id, index, text."""
    w = Window.partitionBy("text_id").orderBy("index").rowsBetween(-buffer, buffer)
    return sentences.withColumn("window_text", F.array_join(F.collect_list("text").over(w), " "))


def breakpoints(windows: DataFrame, percentile: float = 95.0) -> DataFrame:
    """text_id, index, distance, threshold, group: a new group after each distance above the percentile (linear).

    windows: text_id, index, vector.
    """
    from credence.functions.vectors import cosine

    w = Window.partitionBy("text_id").orderBy("index")
    rows = windows.withColumn("next", F.lead("vector").over(w)).withColumn("distance", F.when(F.col("next").isNotNull(), 1.0 - cosine(F.col("vector"), F.col("next"))))
    t = rows.groupBy("text_id").agg(F.percentile("distance", min(100.0, max(0.0, percentile)) / 100.0).alias("threshold"))
    rows = rows.join(t, "text_id").withColumn("breaks", F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)).cast("int"))
    return rows.withColumn("group", F.coalesce(F.sum("breaks").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("text_id", "index", "distance", "threshold", "group")


def without_small_groups(rows: DataFrame, least: int) -> DataFrame:
    """Groups of under `least` sentences merged, first one first, over the nearer of their two bounds (ties: backwards).

    Each step changes the next, so an Arrow kernel for each text. rows: text_id, index, distance, group.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index").reset_index(drop=True)
        starts = [0] + [i for i in range(1, len(pdf)) if pdf["group"][i] != pdf["group"][i - 1]]
        gap = pdf["distance"].tolist()
        while len(starts) > 1:
            ends = starts[1:] + [len(pdf)]
            short = next((k for k, (a, b) in enumerate(zip(starts, ends)) if b - a < least), None)
            if short is None:
                break
            left = gap[starts[short] - 1] if short else None
            right = gap[ends[short] - 1] if short + 1 < len(starts) else None
            del starts[short if left is not None and (right is None or left <= right) else short + 1]
        marks = pd.Series(0, index=pdf.index)
        marks.loc[starts[1:]] = 1
        return pdf.assign(group=marks.cumsum())[["text_id", "index", "group"]]

    kind = dict(rows.dtypes)
    return rows.select("text_id", "index", "distance", "group").groupBy("text_id").applyInPandas(merge, f"text_id {kind['text_id']}, index {kind['index']}, group long")
