"""Turns cut into chunks: every tool call a chunk of its own, the text between by meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from credence.functions import text as X, toolwire as TW
from credence.operators import retrieval as RT


def regions(texts: DataFrame) -> DataFrame:
    """text_id, region, kind (text, tool_call), start, end, content: the whole text in order, blank regions left out.

    texts: text_id, content.
    """
    calls = texts.withColumn("spans", TW.tool_call_spans(F.col("content")))
    n, size = F.length("content"), F.size("spans")
    bound = lambda i, side: F.get("spans", i)[side]
    before = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.lit("text").alias("kind"), F.when(i == 0, 0).otherwise(bound(i - 1, "end")).alias("start"), F.when(i == size, n).otherwise(bound(i, "start")).alias("end")))
    inside = F.transform("spans", lambda s: F.struct(F.lit("tool_call").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = calls.select("text_id", "content", F.explode(F.concat(before, inside)).alias("r")).select("text_id", "content", "r.*").filter("end > start")
    at = X.trimmed_span(F.col("content"), F.col("start"), F.col("end"))
    rows = rows.withColumn("at", at).select("text_id", "kind", F.col("at.start").alias("start"), F.col("at.end").alias("end"), "content").filter("end > start")
    order = F.row_number().over(Window.partitionBy("text_id").orderBy("start")) - 1
    piece = F.substring("content", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return rows.select("text_id", order.alias("region"), "kind", "start", "end", piece.alias("content"))


def chunked(texts: DataFrame, embedder: Callable | None = None, percentile: float = 95.0, buffer: int = 1, least: int = 1) -> DataFrame:
    """text_id, chunk_id, kind, start, end, text, sentences (their number): offsets are those of the whole text.

    Without an embedder (or in a region of one sentence) a region is one chunk, from its first sentence to its last. A
    region that holds no sentence, as it is nothing but tags, is a chunk as it stands.
    """
    parts = regions(texts)
    whole = parts.filter("kind = 'tool_call'").select("text_id", "kind", "start", "end", F.lit(0).alias("sentences"))
    between = parts.filter("kind = 'text'")
    key = F.concat_ws("/", F.col("text_id").cast("string"), F.col("region").cast("string"))
    said = between.withColumn("key", key).select("text_id", "key", "start", "end", F.posexplode_outer(X.split_sentences(F.col("content"))).alias("index", "s"))
    bare = said.filter("s is null").select("text_id", F.lit("text").alias("kind"), "start", "end", F.lit(0).alias("sentences"))
    rows = said.filter("s is not null").select("text_id", "key", "index", F.col("s.text").alias("text"), (F.col("start") + F.col("s.start")).alias("a"), (F.col("start") + F.col("s.end")).alias("b"))
    grouped = rows.withColumn("group", F.lit(0).cast("long"))
    if embedder is not None:
        windows = RT.buffered(rows.select(F.col("key").alias("text_id"), "index", "text"), buffer).withColumn("vector", embedder(F.col("window_text")))
        cut = RT.breakpoints(windows, percentile)
        cut = RT.without_small_groups(cut, least) if least > 1 else cut
        grouped = rows.join(cut.select(F.col("text_id").alias("key"), "index", F.col("group").cast("long").alias("group")), ["key", "index"])
    spans = grouped.groupBy("text_id", "key", "group").agg(F.min("a").alias("start"), F.max("b").alias("end"), F.count("*").cast("int").alias("sentences"))
    every = whole.unionByName(bare).unionByName(spans.select("text_id", F.lit("text").alias("kind"), "start", "end", "sentences"))
    n = F.row_number().over(Window.partitionBy("text_id").orderBy("start")) - 1
    piece = F.substring("content", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return every.withColumn("chunk_id", n).join(texts, "text_id").select("text_id", "chunk_id", "kind", "start", "end", piece.alias("text"), "sentences")
