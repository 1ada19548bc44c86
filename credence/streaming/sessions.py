"""The keyed session machine on Structured Streaming: turns in, messages and closures out, one state a problem."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "problem_id string, kind string, turn_id long, role string, content string, n_fragments long"
SAID = Row(*(x.split()[0] for x in OUTPUT.split(", ")))
_ROLES = {"user", "assistant", "tool", "system"}


class SessionMachine(StatefulProcessor):
    """Fragments become messages; the end of a trajectory closes its problem, and what comes later is rejected.

    kinds: message, skipped (system or blank: the turn id is used up all the same), finalized, rejected.
    State: turns so far, whether closed, and the open fragments. Rows of a problem are taken in order of recv_index
    within a micro-batch; what a later batch brings comes later, whatever its index. With `ttl_ms`, the state of a problem
    that has brought nothing for that long is dropped, closed or not; should it come back, it begins anew.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "turns long, closed boolean", self.ttl_ms)
        self.open = handle.getListState("open", "role string, content string", self.ttl_ms)

    def advance(self, problem: str, rows: Iterator, finish: bool = False) -> list[tuple]:
        """What these rows, taken as they come, make of the problem's state; `finish`: nothing comes after them."""
        # Each call to the state is a message to the JVM, so what hasn't changed isn't written, unless to live on.
        before = self.progress.get()
        turns, closed = before or (0, False)
        held = [tuple(x) for x in self.open.get()] if before else []
        opened = list(held)
        out: list[tuple] = []

        def flush() -> None:
            nonlocal turns, held
            if held:
                role, text = held[-1][0], "".join(t for _, t in held)
                kind = "skipped" if role == "system" or not text.strip() else "message"
                out.append((problem, kind, turns, role, text, len(held)))
                turns, held = turns + 1, []

        for row in rows:
            role = {"function": "tool"}.get(row.role, row.role)
            if closed or role not in _ROLES:
                out.append((problem, "rejected", None, row.role, row.content, 1))
                continue
            if held and held[-1][0] != role:
                flush()
            held.append((role, row.content if isinstance(row.content, str) else ""))
            last = bool(row.is_trajectory_end) if row.is_trajectory_end is not None else False
            if last or row.is_message_end is None or bool(row.is_message_end):
                flush()
            if last:
                closed = True
                out.append((problem, "finalized", turns, None, None, 0))
        if finish and not closed:
            flush()
            closed = True
            out.append((problem, "finalized", turns, None, None, 0))
        if before != (turns, closed) or self.ttl_ms is not None:
            self.progress.update((turns, closed))
        if held and (held != opened or self.ttl_ms is not None):
            self.open.put(held)
        elif opened and not held:
            self.open.clear()
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        whole = sorted(rows, key=lambda r: (r.recv_index is None, r.recv_index))
        yield from (SAID(*x) for x in self.advance(key[0], iter(whole)))

    def close(self) -> None:
        pass


def sessions(turns: DataFrame, ttl_minutes: float | None = None) -> DataFrame:
    """Streaming turns (problem_id, role, content, is_message_end, is_trajectory_end, recv_index) through the machine.

    Needs the RocksDB state store provider, as all arbitrary state of this kind does. Without `ttl_minutes` state is kept
    for good; with it, batches go on without data, so a run that is to end when its input does can't have it.
    """
    rows = turns.select("problem_id", "role", "content", "is_message_end", "is_trajectory_end", "recv_index").filter("problem_id is not null")
    return rows.groupBy("problem_id").transformWithState(SessionMachine(None if ttl_minutes is None else int(ttl_minutes * 60_000)), OUTPUT, "Append", "None" if ttl_minutes is None else "ProcessingTime")


#: The state store that arbitrary state needs; batches write what changed, not a snapshot each.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """That store for the streams that are started within."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_once(turns: DataFrame, root: str) -> DataFrame:
    """What the machine says of a stream of turns that are all there, written below root; the state store is set for the run."""
    spark = turns.sparkSession
    with rocksdb(spark):
        out = sessions(turns).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{root}/out")


def batch_equivalent(turns: DataFrame) -> DataFrame:
    """problem_id, messages, rejected: what the machine says of a finished input, by windows alone."""
    from pyspark.sql import Window

    w = Window.partitionBy("problem_id").orderBy("recv_index").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce("is_trajectory_end", F.lit(False))
    rows = turns.withColumn("late", F.coalesce(F.max(end.cast("int")).over(w), F.lit(0)) == 1)
    from credence.operators.turns import assembled

    messages = assembled(rows.filter("not late")).groupBy("problem_id").agg(F.count("*").alias("messages"))
    late = rows.groupBy("problem_id").agg(F.count_if("late").alias("rejected"))
    return late.join(messages, "problem_id", "left").select("problem_id", F.coalesce("messages", F.lit(0)).alias("messages"), "rejected")


def released(state_dir_table: DataFrame, problem_ids: list[str]) -> DataFrame:
    """A stored state table without the problems that were released; artifacts stay where they are."""
    return state_dir_table.filter(~F.col("problem_id").isin(problem_ids))


#: Folders of a log of fragments.
BUCKETS = 32


def write_history(df: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Append everything that comes, fragments too, in folders by hash of the problem: their number doesn't grow."""
    rows = df.withColumn("bucket", F.pmod(F.xxhash64("problem_id"), F.lit(buckets)).cast("int"))
    return rows.writeStream.format("json").outputMode("append").partitionBy("bucket").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums in event-time windows; works on streams (with a watermark) and tables alike."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def ledger(desired: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """session, reset, push (positions to send): what was acknowledged must be a prefix of what is wanted, else all anew.

    Both: session, pos, digest.
    """
    d = desired.select("session", "pos", F.col("digest").alias("want"))
    a = acknowledged.select("session", "pos", F.col("digest").alias("have"))
    rows = d.join(a, ["session", "pos"], "full")
    ok = F.bool_and(F.col("have").isNull() | F.coalesce(F.col("have") == F.col("want"), F.lit(False))).over(_session())
    rows = rows.withColumn("prefix", ok)
    send = F.col("want").isNotNull() & (F.col("have").isNull() | ~F.col("prefix"))
    return rows.groupBy("session").agg((~F.bool_and("prefix")).alias("reset"), F.array_sort(F.collect_list(F.when(send, F.col("pos")))).alias("push"))


def _session():
    from pyspark.sql import Window

    return Window.partitionBy("session")


def digest(*columns: str):
    """SHA-256 of a row as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def is_subsequence(wanted, actual):
    """Whether an array's values occur in another in order."""
    return F.aggregate(actual, F.lit(0), lambda k, x: F.when((k < F.size(wanted)) & (F.get(wanted, k) == x), k + 1).otherwise(k)) == F.size(wanted)
