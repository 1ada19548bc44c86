"""Trajectories from JSON: shapes told apart, sessions flattened in order, messages made turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from credence.functions.text import parsed_date

MESSAGE = "struct<role:string,content:string,has_answer:boolean>"
_M = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("has_answer", T.BooleanType())])
_TEXTS, _TURNS = T.ArrayType(T.StringType()), T.ArrayType(_M)
ITEM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("question_id", "item_id", "question", "answer", "question_type", "question_date")]
    + [T.StructField("trajectory", _TURNS), T.StructField("messages", _TURNS), T.StructField("sessions", T.ArrayType(_TURNS)), T.StructField("session_ids", _TEXTS), T.StructField("dates", _TEXTS)]
)


def read_items(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Items of JSON files of any of four shapes: {trajectory}, {messages}, a list of messages, or a list of items with sessions.

    lines: each line of a file is what a file is otherwise; many small trajectories come in few files then.
    """
    raw = spark.read.text(path, wholetext=not lines).filter((F.trim("value") != "") | F.lit(not lines))
    is_list = F.ltrim("value").startswith("[")
    items = F.from_json("value", T.ArrayType(ITEM))
    bare = F.from_json("value", f"array<{MESSAGE}>")
    has_items = F.exists(items, lambda x: x["sessions"].isNotNull() | x["trajectory"].isNotNull() | x["messages"].isNotNull())
    one = F.from_json("value", ITEM)
    only_messages = F.array(F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name != "messages" else bare.alias("messages") for f in ITEM.fields)))
    rows = raw.select(F.when(is_list & has_items, items).when(is_list, only_messages).otherwise(F.array(one)).alias("items"))
    return rows.select(F.posexplode("items").alias("pos", "item")).select("pos", "item.*").withColumn("item_id", F.coalesce("question_id", "item_id", F.concat(F.lit("item_"), F.col("pos").cast("string"))))


def is_sessioned(items: DataFrame) -> bool:
    return "sessions" in items.columns


def turns(items: DataFrame, keep_order: bool = False) -> DataFrame:
    """item_id, turn_id, session_index, role, content, date, has_answer, order_sorted.

    Sessions are sorted by date, stably, only if every one of the item's dates can be read and keep_order is off. A
    missing role is user, a missing content empty.
    """
    base = items.withColumn("plain", F.coalesce("trajectory", "messages")).withColumn("n_dates", F.coalesce(F.size("dates"), F.lit(0)))
    grouped = base.select("item_id", F.when(F.col("sessions").isNotNull(), F.col("sessions")).otherwise(F.array("plain")).alias("sessions"), F.coalesce("dates", F.array().cast("array<string>")).alias("dates"))
    per_session = grouped.select("item_id", F.posexplode("sessions").alias("session_index", "messages"), F.col("dates"))
    dated = per_session.withColumn("date", F.get("dates", F.col("session_index"))).withColumn("at", parsed_date(F.col("date")))
    item = Window.partitionBy("item_id")
    sortable = F.bool_and(F.col("at").isNotNull()).over(item) & F.lit(not keep_order)
    dated = dated.withColumn("order_sorted", sortable).withColumn("rank", F.when(F.col("order_sorted"), F.col("at")))
    flat = dated.select("item_id", "session_index", "date", "rank", "order_sorted", F.posexplode("messages").alias("pos", "m"))
    number = F.row_number().over(item.orderBy(F.col("rank").asc_nulls_first(), "session_index", "pos")) - 1
    return flat.filter(F.col("m").isNotNull()).select(
        "item_id", number.cast("long").alias("turn_id"), "session_index", F.coalesce("m.role", F.lit("user")).alias("role"), F.coalesce("m.content", F.lit("")).alias("content"), "date", F.col("m.has_answer").alias("has_answer"), "order_sorted"
    )


def select_item(items: DataFrame, selector: str) -> DataFrame:
    """The item of that id; else the one at that 0-based place; else an error."""
    hit = items.filter(F.col("item_id") == selector)
    if hit.isEmpty() and selector.isdigit():
        from credence.operators.numbering import numbered

        place = items.withColumnRenamed("pos", "__n") if "pos" in items.columns else numbered(items, "item_id", name="__n")
        hit = place.filter(F.col("__n") == int(selector)).withColumnRenamed("__n", "pos").select(*items.columns)
    if hit.isEmpty():
        raise KeyError(selector)
    return hit


def ndjson_turns(lines: DataFrame) -> DataFrame:
    """Turns of lines of JSON (batch or stream); blank, malformed and non-object lines are dropped."""
    from credence.schema import WIRE_TURN

    row = F.when(F.ltrim("value").startswith("{"), F.from_json("value", WIRE_TURN))
    return lines.filter(F.trim("value") != "").select(row.alias("t")).filter(F.col("t.problem_id").isNotNull()).select("t.*")


def body_turns(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Turns of request bodies: an array of objects, or lines of them; malformed bodies raise."""
    from credence.schema import WIRE_TURN

    body = F.trim(column)
    array = F.from_json(body, T.ArrayType(WIRE_TURN), {"mode": "FAILFAST"})
    lines = F.transform(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, WIRE_TURN, {"mode": "FAILFAST"}))
    return bodies.select(F.explode(F.when(body.startswith("["), array).otherwise(lines)).alias("t")).select("t.*")
