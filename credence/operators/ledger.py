"""Calls of a model as a ledger: each request asked in batches, retried until it succeeds, never asked again after that.

The model is a function from Arrow batches to Arrow batches, given by the caller; this engine has none of its own. A request is
known by the digest of its label and prompt, so equal ones are asked once. Requests are dealt out by digest, and each task forms
batches that hold `budget` tokens at most (a larger request goes alone). What came of every one is a row of the round's table.

* ok: the answer stands, and the request takes no part in later rounds;
* failed: asked again in the next round, as it was;
* overflow: asked again with half the tokens to answer in, as long as those are LEAST_TOKENS.

A round is a table in the ledger's folder, written whole or not at all. A run that was broken off goes on after the last whole round, so
only requests of the broken one can be asked twice (as they can if an executor is lost).

Nulls and edges: a null prompt is no request; a null label is one of its own; any other status than these counts as failed, so does
a null one; what isn't ok after `retries` rounds keeps its last status and has no answer; an empty table asks nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from credence.functions import text as X, toolwire as TW

LEAST_TOKENS = 16
ROUND = "digest string, attempt int, limit int, status string, answer string, batch string"
Model = Callable[[pa.RecordBatch], pa.RecordBatch]


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _whole(spark: SparkSession, path: str) -> bool:
    p, files = _files(spark, f"{path}/_SUCCESS")
    return files.exists(p)


def _rounds(spark: SparkSession, root: str, attempt: int) -> DataFrame | None:
    """The rows of the rounds before this one."""
    paths = [f"{root}/round={k}" for k in range(1, attempt)]
    return spark.read.schema(ROUND).parquet(*paths) if paths else None


def digested(requests: DataFrame) -> DataFrame:
    """requests with `digest`, of label and prompt."""
    return requests.withColumn("digest", F.sha2(F.to_json(F.struct("label", "prompt"), {"ignoreNullFields": "false"}), 256))


def _pending(requests: DataFrame, before: DataFrame | None, most_tokens: int) -> DataFrame:
    """digest, prompt, label, tokens, limit of what is to be asked now."""
    if before is None:
        return requests.withColumn("limit", F.lit(most_tokens))
    last = before.groupBy("digest").agg(F.max_by(F.struct("status", "limit"), "attempt").alias("last"))
    rows = requests.join(last, "digest")
    half = F.floor(F.col("last.limit") / 2).cast("int")
    again = F.when(F.col("last.status") == "overflow", F.when(half >= LEAST_TOKENS, half)).when(F.col("last.status") == "failed", F.col("last.limit"))
    return rows.withColumn("limit", again).filter("limit is not null").drop("last")


def _asked(pending: DataFrame, model: Model, budget: int, attempt: int) -> DataFrame:
    """Ask what is pending, batch by batch."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        used = 0
        for part in parts:
            for i, n in enumerate(part.column("tokens").to_pylist()):
                if held and used + n > budget:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, used = [], 0
                held.append(part.slice(i, 1))
                used += n
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            said = model(batch)
            status = [s if s in ("ok", "overflow") else "failed" for s in said.column("status").to_pylist()]
            answers = [a if s == "ok" else None for a, s in zip(said.column("answer").to_pylist(), status)]
            n, digests = batch.num_rows, batch.column("digest")
            columns = [digests, pa.array([attempt] * n, pa.int32()), batch.column("limit"), pa.array(status), pa.array(answers, pa.string()), pa.array([digests[0].as_py()] * n)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ROUND.split(", ")])

    rows = pending.select("digest", "label", "prompt", "tokens", "limit", F.lit(attempt).alias("attempt"))
    return rows.repartition("digest").sortWithinPartitions("digest").mapInArrow(run, ROUND)


def ask(requests: DataFrame, model: Model, root: str, budget: int = 4000, most_tokens: int = 256, retries: int = 8) -> DataFrame:
    """digest, status, answer, attempts, limit of each request (label, prompt) after as many rounds as it takes.

    model: batches of digest, label, prompt, tokens, limit, attempt to batches of status and answer, row for row.
    """
    spark = requests.sparkSession
    once = digested(requests.filter("prompt is not null")).select("digest", "label", "prompt", X.estimate_tokens(F.col("prompt")).alias("tokens")).dropDuplicates(["digest"])
    if not _whole(spark, f"{root}/requests"):
        once.write.mode("overwrite").parquet(f"{root}/requests")
    once = spark.read.schema(once.schema).parquet(f"{root}/requests")
    attempt = 1
    while attempt <= retries:
        path = f"{root}/round={attempt}"
        if not _whole(spark, path):
            pending = _pending(once, _rounds(spark, root, attempt), most_tokens)
            if pending.isEmpty():
                break
            _asked(pending, model, budget, attempt).write.mode("overwrite").parquet(path)
        attempt += 1
    return outcome(_rounds(spark, root, attempt)) if attempt > 1 else outcome(spark.createDataFrame([], ROUND))


def outcome(rounds: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("status", "answer", "limit"), "attempt").alias("x")
    return rounds.groupBy("digest").agg(last, F.max("attempt").alias("attempts")).select("digest", "x.status", "x.answer", "attempts", "x.limit")


def prepared(turns: DataFrame, most_semantic: int = 6) -> DataFrame:
    """How each assistant or tool turn is prepared: item_id, turn_id, kind, batch, place.

    Consecutive tool results are one batch, asked at once, named by their first turn; an item's first `most_semantic` results are
    asked about, later ones are cut out by rule. An assistant turn of calls alone is cut out by rule, any other is a batch of its own.
    turns: item_id, turn_id, role, content, without gaps that matter: a turn of another role ends a batch.
    """
    w = Window.partitionBy("item_id").orderBy("turn_id")
    rows = turns.withColumn("new", (F.col("role") != "tool") | (F.coalesce(F.lag("role").over(w), F.lit("")) != "tool"))
    rows = rows.withColumn("run", F.sum(F.col("new").cast("int")).over(w)).withColumn("results", F.sum((F.col("role") == "tool").cast("int")).over(w))
    run = Window.partitionBy("item_id", "run")
    by_rule = F.when(F.col("role") == "tool", F.col("results") > most_semantic).otherwise(TW.is_pure_tool_call(F.col("content")))
    kind = F.when(by_rule, "rule").when(F.col("role") == "tool", "tools").otherwise("assistant")
    out = rows.withColumn("batch", F.min("turn_id").over(run)).withColumn("place", (F.row_number().over(run.orderBy("turn_id")) - 1).cast("int"))
    return out.filter(F.col("role").isin("assistant", "tool")).select("item_id", "turn_id", kind.alias("kind"), "batch", "place")


def batch_requests(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """item_id, batch, label, prompt: one request for each batch that is asked, its contents numbered and in order."""
    rows = plan.filter("kind <> 'rule'").join(turns.select("item_id", "turn_id", "content"), ["item_id", "turn_id"])
    parts = F.array_sort(F.collect_list(F.struct("place", "content")))
    text = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("["), x["place"].cast("string"), F.lit("] "), F.coalesce(x["content"], F.lit("")))), "\n")
    return rows.groupBy("item_id", "batch", F.col("kind").alias("label")).agg(text.alias("prompt"))
