"""Nodes: eligibility, search, context, decisions, normal forms, windows and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from credence.functions import text as X


def eligible(nodes: DataFrame) -> DataFrame:
    """Nodes that may enter a context: with an id and a text, not of the pinned turns 0 and 1, no empty search."""
    turn = F.coalesce("turn_id", F.lit(-1))
    return nodes.filter(F.col("id").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != "") & ((turn < 0) | (turn > 1)) & ~X.is_empty_search(F.trim("text")))


def contains_any(text: Column, needles: list[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*(F.lit(n.lower()) for n in needles)), lambda n: low.contains(n)) if needles else F.lit(True)


def believe(nodes: DataFrame, target: str, most: int = 10) -> DataFrame:
    return nodes.filter(contains_any(F.col("text"), [target])).orderBy("id").limit(most)


def context(nodes: DataFrame, focal: list[str], most: int = 100) -> DataFrame:
    """Nodes with any of the focal terms, the most confident first, then by id."""
    return nodes.filter(contains_any(F.col("text"), focal)).orderBy(F.desc("confidence"), "id").limit(most)


def search(nodes: DataFrame, query: str, most: int = 10) -> DataFrame:
    return nodes.filter(contains_any(F.col("text"), [query])).orderBy(F.desc("confidence"), "id").limit(most)


def question_constraints(nodes: DataFrame, most: int = 12) -> DataFrame:
    """item_id, rank, text: distinct user statements of turn 1 that are no instructions; the first `most`."""
    rows = nodes.filter((F.col("turn_id") == 1) & (F.col("role").isNull() | (F.col("role") == "user")) & (F.trim("text") != "") & ~X.is_instruction(F.col("text")))
    rows = rows.withColumn("text", F.trim("text")).withColumn("fold", F.lower("text"))
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("item_id", "fold").orderBy("id"))).filter("rn = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("id"))).filter(F.col("rank") <= most).select("item_id", "rank", "text")


def constraints_or_question(constraints: DataFrame, questions: DataFrame) -> DataFrame:
    """Constraints, and for items without any the question itself."""
    rest = questions.join(constraints.select("item_id").distinct(), "item_id", "left_anti").select("item_id", F.lit(1).alias("rank"), F.col("question").alias("text"))
    return constraints.unionByName(rest)


def latest_decision(nodes: DataFrame) -> DataFrame:
    """One decision an item: the latest by greatest id of itself and what it absorbed, then turn, then id; others become beliefs.

    decision_history: the ids of the others, in order.
    """
    key = F.struct(F.greatest("id", F.coalesce(F.array_max("merged_from"), F.col("id"))).alias("k"), "turn_id", "id")
    w = Window.partitionBy("item_id")
    top = F.max(F.when(F.col("node_type") == "decision", key)).over(w)
    rows = nodes.withColumn("__top", top["id"]).withColumn("__all", F.array_sort(F.collect_list(F.when(F.col("node_type") == "decision", F.col("id"))).over(w)))
    is_top = (F.col("node_type") == "decision") & (F.col("id") == F.col("__top"))
    return rows.withColumn("decision_history", F.when(is_top, F.array_remove("__all", F.col("__top")))).withColumn("node_type", F.when((F.col("node_type") == "decision") & ~is_top, "belief").otherwise(F.col("node_type"))).drop("__top", "__all")


def recency(nodes: DataFrame, by: str = "item_id") -> DataFrame:
    w = Window.partitionBy(by)
    low, high = F.min("turn_id").over(w), F.max("turn_id").over(w)
    return nodes.withColumn("recency", (F.col("turn_id") - low) / F.greatest(F.lit(1), high - low))


def normalized(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Min-max within a group; 1 for all where all are equal (relative 1e-9)."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    same = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(low), F.abs(high))
    return rows.withColumn("normalized", F.when(same, 1.0).otherwise((F.col(value) - low) / F.when(same, F.lit(None)).otherwise(high - low)))


def display_order(nodes: DataFrame) -> DataFrame:
    """rank: facts before searches; confidence in thousandths, a hundred more for summarised results and less for raw ones."""
    bonus = F.when(F.col("extraction_method") == "compact_llm_tool_result", 100).when(F.col("extraction_method") == "rule_tool_result", -100).otherwise(0)
    is_search = X.is_search(F.col("extraction_method"), F.col("query"))
    w = Window.partitionBy("item_id").orderBy(is_search.cast("int"), F.when(is_search, F.lit(0.0)).otherwise(-(F.coalesce("confidence", F.lit(0.5)) * 1000 + bonus)), F.desc("turn_id"), F.desc("id"))
    return nodes.withColumn("rank", F.row_number().over(w))


def adjustment() -> Column:
    """A node's bonus by how it was found and how long it is. Fixed values."""
    m = F.col("extraction_method")
    return (
        F.when(m == "compact_llm_tool_result", 0.12).otherwise(0.0) - F.when(m == "rule_tool_result", 0.06).otherwise(0.0) - F.when(X.is_search(m, F.col("query")), 0.04).otherwise(0.0)
        - F.least(F.lit(0.08), F.greatest(F.lit(0), F.length(F.trim("text")) - 320) / 12000.0)
    )


def timeline(nodes: DataFrame, width: float = 1000.0, height: float = 600.0) -> DataFrame:
    """x by turn, y by id within the turn."""
    item = Window.partitionBy("item_id")
    column = F.dense_rank().over(item.orderBy("turn_id"))
    row = F.row_number().over(Window.partitionBy("item_id", "turn_id").orderBy("id"))
    rows = nodes.withColumn("column", column).withColumn("row", row)
    columns, in_column = F.max("column").over(item), F.count("*").over(Window.partitionBy("item_id", "turn_id"))
    return rows.withColumn("x", F.col("column") * width / (columns + 1)).withColumn("y", F.col("row") * height / (in_column + 1))


def star_layout(nodes: DataFrame, radius: float = 300.0) -> DataFrame:
    """Levels by type and an even angle within each level."""
    level = F.when(F.col("node_type") == "decision", 0).when(F.col("node_type") == "belief", 1).otherwise(2)
    rows = nodes.withColumn("level", level)
    k = F.row_number().over(Window.partitionBy("item_id", "level").orderBy("id")) - 1
    n = F.count("*").over(Window.partitionBy("item_id", "level"))
    angle = 2 * F.pi() * k / n
    return rows.withColumn("x", F.col("level") * radius * F.cos(angle)).withColumn("y", F.col("level") * radius * F.sin(angle))


def unified_nodes(*lists: DataFrame) -> DataFrame:
    """A viewer's nodes from several lists: the first of each id, in the order of the lists."""
    rows = None
    for i, df in enumerate(lists):
        d = df.withColumn("__from", F.lit(i))
        rows = d if rows is None else rows.unionByName(d, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("id").orderBy("__from"))
    return rows.withColumn("__n", first).filter("__n = 1").drop("__n", "__from").orderBy("id")


def factors(rows: DataFrame) -> DataFrame:
    """Factors with missing ids filled by the smallest unused numbers from 0, by order of appearance (`pos`)."""
    from credence.operators.numbering import numbered, unused

    missing = numbered(rows.filter("id is null").drop("id"), "pos")
    filled = unused(rows.filter("id is not null").select("id"), missing).select(*rows.columns)
    return rows.filter("id is not null").unionByName(filled).orderBy("id")


def decision_history(documents: DataFrame) -> DataFrame:
    """item_id, decision_id: of lists under any of three names. documents: item_id, decision_history, decisions, history (arrays)."""
    rows = documents.select("item_id", F.explode(F.concat(*(F.coalesce(c, F.array().cast("array<bigint>")) for c in ("decision_history", "decisions", "history")))).alias("decision_id"))
    return rows.distinct()


def entity_kind(label: Column) -> Column:
    """A coarse kind of an entity label. Fixed values."""
    low = F.lower(label)
    return (
        F.when(low.isin("person", "per", "people"), "person").when(low.isin("org", "organization", "company", "institution"), "organization").when(low.isin("loc", "gpe", "location", "place", "facility", "fac"), "place")
        .when(low.isin("date", "time", "event"), "time").when(low.isin("url", "email", "file", "path"), "reference").otherwise("other")
    )


def valid_surface(text: Column) -> Column:
    """A surface that can be an entity: two letters or more, not only digits, no stop phrase."""
    t = F.trim(text)
    return (F.length(t) >= 2) & ~t.rlike(r"^[\d\W]+$") & ~F.lower(t).isin("the", "this", "that", "it", "he", "she", "they", "we", "you", "i", "user", "assistant")


def node_cap(size: Column, ratio: float = 0.5, low: int = 1, high: int = 12) -> Column:
    """How many nodes a chunk of `size` sentences may give."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.ceil(size * ratio))).cast("long")
