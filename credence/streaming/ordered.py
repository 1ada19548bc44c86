"""Sessions whose rows come in disorder, what is known of them while a stream runs, and the closing of a stream.

Each problem's rows carry recv_index, counted from 0. Rows that came before one they have to follow wait in map state; as soon as
it is there, they go on to the session machine. A row that never comes is given up once the watermark, `patience` behind the
latest received_at, has passed a row that waits for it: its event-time timer goes off, and what was received until then goes on
in order. A closing batch gives up all gaps and ends each session that is still open, once.

Nulls and edges: rows without a problem are left out; a row without an index or a time can't be put in order and is left out; an index
that was taken, given up or is waiting already is told as `late`; rows that are older than the watermark are dropped by Spark, as
late data is; finishing twice, or finishing a stream without open sessions, says nothing more.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from credence.streaming.sessions import OUTPUT, SAID, SessionMachine, rocksdb

Turn = namedtuple("Turn", "role content is_message_end is_trajectory_end")
#: Indices of one entry of the map of what waits. Each call to the state is a message to the JVM, so rows don't go singly.
BLOCK = 64


class Waiting:
    """What waits of one problem: rows by index, in blocks that are read when they are asked for and written if they changed."""

    def __init__(self, state, new: bool):
        self.state, self.new = state, new
        self.blocks: dict[int, dict[int, tuple]] = {}
        self.stored: set[int] = set()
        self.changed: set[int] = set()
        self.since: int | None = None  # the earliest received_ms of what was stored, as far as it was read

    def block(self, i: int) -> dict[int, tuple]:
        b = i // BLOCK
        if b not in self.blocks:
            found = None if self.new else self.state.getValue((b,))
            self._loaded(b, found)
        return self.blocks[b]

    def _loaded(self, b: int, found) -> None:
        self.blocks[b] = {x[0]: tuple(x[1:]) for x in found[0]} if found else {}
        if found:
            self.stored.add(b)
            self.since = min([x[4] for x in self.blocks[b].values()] + ([] if self.since is None else [self.since]))

    def put(self, i: int, row: tuple) -> None:
        self.block(i)[i] = row
        self.changed.add(i // BLOCK)

    def take(self, i: int) -> Turn | None:
        row = self.block(i).pop(i, None)
        if row is None:
            return None
        self.changed.add(i // BLOCK)
        return Turn(*row[:4])

    def indices(self) -> list[int]:
        """All that waits; blocks that are known already are as they are now, not as they were stored."""
        if not self.new:
            for key, found in self.state.iterator():
                if key[0] not in self.blocks:
                    self._loaded(key[0], found)
        return sorted(i for rows in self.blocks.values() for i in rows)

    def write(self) -> None:
        for b in sorted(self.changed):
            if self.blocks[b]:
                self.state.updateValue((b,), ([(i, *row) for i, row in sorted(self.blocks[b].items())],))
            elif b in self.stored:
                self.state.removeKey((b,))


class OrderedMachine(SessionMachine):
    """The session machine behind a reorder buffer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "block long", "rows array<struct<recv_index: long, role: string, content: string, is_message_end: boolean, is_trajectory_end: boolean, received_ms: long>>")
        self.place = handle.getValueState("place", "next long, received_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        place = self.place.get()
        next_index, latest = place or (0, 0)
        held = Waiting(self.waiting, place is None)
        finish, ready, late, come = False, [], [], {}
        for r in sorted(rows, key=lambda r: r.recv_index):
            if r.close:
                finish = True
                continue
            i, latest = r.recv_index, max(latest, r.received_ms)
            if i < next_index or i in held.block(i):
                late.append((key[0], "late", None, r.role, r.content, 1))
            else:
                held.put(i, (r.role, r.content, r.is_message_end, r.is_trajectory_end, r.received_ms))
                come[i] = r.received_ms
        if finish or come:
            while (row := held.take(next_index)) is not None:
                ready.append(row)
                next_index += 1
        if finish:
            left = held.indices()
            ready += [held.take(i) for i in left]
            next_index = max([next_index, *(i + 1 for i in left)])
        waits = [ms for i, ms in come.items() if i >= next_index]
        # A timer for the earliest does: when it goes off, the rest gets its own. What waited before has one.
        if waits and (held.since is None or held.since > min(waits)):
            self.handle.registerTimer(min(waits))
        held.write()
        if place != (next_index, latest):
            self.place.update((next_index, latest))
        said = self.advance(key[0], iter(ready), finish) if ready or finish or place is None else []
        yield from (SAID(*x) for x in said + late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        held = Waiting(self.waiting, False)
        left = held.indices()
        since = {i: held.block(i)[i][4] for i in left}
        last = max((i for i in left if since[i] <= until or since[i] < now), default=None)
        ready: list[Turn] = []
        if last is not None:
            for i in left:
                if i > last + 1:
                    break
                ready.append(held.take(i))
                last = max(last, i)
            next_index, latest = self.place.get()
            self.place.update((max(next_index, last + 1), latest))
            held.write()
        if rest := left[len(ready) :]:
            self.handle.registerTimer(min(since[i] for i in rest))
        yield from (SAID(*x) for x in (self.advance(key[0], iter(ready)) if ready else []))


_INPUT = ("problem_id", "role", "content", "is_message_end", "is_trajectory_end", "recv_index", "received_at", "received_ms", "close")


def sessions(turns: DataFrame, patience: str) -> DataFrame:
    """Streaming turns (problem_id, role, content, is_message_end, is_trajectory_end, recv_index, received_at, close) in order
    through the machine. Needs the RocksDB state store provider."""
    close = F.coalesce("close", F.lit(False)) if "close" in turns.columns else F.lit(False)
    rows = turns.withColumn("close", close).withColumn("received_ms", F.unix_millis("received_at")).select(*_INPUT).filter("problem_id is not null and received_at is not null and (close or recv_index is not null)")
    rows = rows.withColumn("recv_index", F.coalesce("recv_index", F.lit(-1).cast("long")))  # of closing rows
    return rows.withWatermark("received_at", patience).groupBy("problem_id").transformWithState(OrderedMachine(), OUTPUT, "Append", "EventTime")


def run(spark: SparkSession, root: str, schema: T.StructType, patience: str, files: int | None = None) -> None:
    """Take in what has come to root/in since the last run, `files` of it at a time; what the machine says goes to root/out."""
    whole = T.StructType([*schema.fields, *([] if "close" in schema.names else [T.StructField("close", T.BooleanType())])])
    with rocksdb(spark):
        reader = spark.readStream.schema(whole)
        stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{root}/in")
        out = sessions(stream, patience).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()


def finish(spark: SparkSession, root: str, schema: T.StructType, patience: str) -> None:
    """A closing batch: a row for each session that its state says is open, and a run that takes it in."""
    state = live(spark, f"{root}/checkpoint").filter("not closed").select("problem_id")
    last = _variable(spark, f"{root}/checkpoint", "place").agg(F.max("value.received_ms")).first()[0]
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in ("problem_id", "received_at", "close")]
    rows = state.select("problem_id", *none, F.timestamp_millis(F.lit(last or 0)).alias("received_at"), F.lit(True).alias("close"))
    rows.write.mode("append").parquet(f"{root}/in")
    run(spark, root, schema, patience)


def said(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(OUTPUT).parquet(f"{root}/out")


def _variable(spark: SparkSession, checkpoint: str, name: str, **options: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).options(**options).load(checkpoint)


def live(spark: SparkSession, checkpoint: str) -> DataFrame:
    """problem_id, turns, closed, and the open message's n_fragments, role and content (null if none), from a stream's checkpoint.

    What it says is as of the last batch that the stream has committed; the stream may go on meanwhile.
    """
    progress = _variable(spark, checkpoint, "progress").select(F.col("key.problem_id").alias("problem_id"), "value.turns", "value.closed")
    fragments = _variable(spark, checkpoint, "open", flattenCollectionTypes="false").select(F.col("key.problem_id").alias("problem_id"), F.col("list_value").alias("held"))
    text = F.array_join(F.transform("held", lambda x: x["content"]), "")
    opened = fragments.filter(F.size("held") > 0).select("problem_id", F.size("held").cast("long").alias("n"), F.element_at("held", -1)["role"].alias("role"), text.alias("content"))
    return progress.join(opened, "problem_id", "left").select("problem_id", "turns", "closed", F.coalesce("n", F.lit(0)).cast("long").alias("n_fragments"), "role", "content")
