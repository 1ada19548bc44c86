"""Reorder buffer, closing batches, live state and the snapshot sink."""

import datetime as dt
import glob
import json
import os
from types import SimpleNamespace

import numpy as np
import pytest

from credence.streaming import ordered as O, snapshots as S

SCHEMA = "problem_id string, role string, content string, is_message_end boolean, is_trajectory_end boolean, recv_index long, received_at timestamp"
START = dt.datetime(2024, 1, 1, 10)


def row(problem, i, content, minutes=0.0, role="user", end=None, last=False):
    return (problem, role, content, end, last, i, START + dt.timedelta(minutes=minutes))


class Feed:
    def __init__(self, spark, path):
        self.spark, self.root, self.files = spark, f"file://{path}", 0

    def put(self, *rows, patience="10 minutes"):
        df = self.spark.createDataFrame(rows, SCHEMA)
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        O.run(self.spark, self.root, df.schema, patience)
        self.schema = df.schema

    def finish(self):
        O.finish(self.spark, self.root, self.schema, "10 minutes")

    def said(self):
        return sorted(((r["problem_id"], r["kind"], r["turn_id"], r["content"], r["n_fragments"]) for r in O.said(self.spark, self.root).collect()), key=repr)

    def live(self):
        return {r["problem_id"]: (r["turns"], r["closed"], r["n_fragments"], r["content"]) for r in O.live(self.spark, f"{self.root}/checkpoint").collect()}


def test_disorder_gaps_and_closing(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put(row("a", 1, "two", 1), row("a", 0, "one"), row("b", 2, "late part", 2), row("c", 0, "half", end=False))
    assert feed.said() == [("a", "message", 0, "one", 1), ("a", "message", 1, "two", 1)]
    assert feed.live() == {"a": (2, False, 0, None), "b": (0, False, 0, None), "c": (0, False, 1, "half")}
    feed.put(row("b", 0, "first", 3), row("a", 1, "again", 3), row("c", 1, " done", 3), row("a", 2, "three", 3, last=True))
    assert feed.live()["a"] == (3, True, 0, None) and feed.live()["b"] == (1, False, 0, None)
    assert ("a", "late", None, "again", 1) in feed.said() and ("c", "message", 0, "half done", 2) in feed.said()
    feed.put(row("d", 0, "an hour on", 70, end=False))  # b's row 1 is given up
    assert ("b", "message", 1, "late part", 1) in feed.said()
    feed.put(row("b", 1, "too late", 71), row("b", 4, "waits", 72))
    assert ("b", "late", None, "too late", 1) in feed.said() and feed.live()["b"][0] == 2
    feed.finish()
    said = feed.said()
    assert [x for x in said if x[1] == "finalized"] == [("a", "finalized", 3, None, 0), ("b", "finalized", 3, None, 0), ("c", "finalized", 1, None, 0), ("d", "finalized", 1, None, 0)]
    assert ("b", "message", 2, "waits", 1) in said and ("d", "message", 0, "an hour on", 1) in said
    feed.finish()
    assert feed.said() == said and all(x[1] for x in feed.live().values())


def test_shuffled_over_many_batches_as_in_order(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [row(f"p{p}", i, f"{p}-{i} ", i / 10, role=["user", "assistant"][i // 3 % 2], end=bool(i % 3 == 2)) for p in range(5) for i in range(12)]
    feeds = Feed(spark, tmp_path / "one"), Feed(spark, tmp_path / "many")
    feeds[0].put(*rows)
    mixed = [rows[k] for k in rng.permutation(len(rows))]
    df = spark.createDataFrame(mixed, SCHEMA)
    feeds[1].schema = df.schema
    df.repartition(6).write.parquet(f"{feeds[1].root}/in")
    O.run(spark, feeds[1].root, df.schema, "10 minutes", files=1)
    assert len(glob.glob(f"{tmp_path}/many/checkpoint/commits/[0-9]*")) >= 6
    for f in feeds:
        f.finish()
    assert feeds[0].said() == feeds[1].said() and len(feeds[0].said()) == 5 * 5


class Calls:
    """A map state that counts the calls to it."""

    def __init__(self):
        self.map, self.calls = {}, 0

    def __getattr__(self, name):
        self.__dict__["calls"] += 1
        return {"getValue": self.map.get, "updateValue": self.map.__setitem__, "removeKey": self.map.pop, "iterator": lambda: iter(list(self.map.items()))}[name]


def test_what_waits_goes_to_the_state_in_blocks():
    state, n = Calls(), 10 * O.BLOCK
    held = O.Waiting(state, True)
    for i in range(1, n):
        held.put(i, ("user", f"{i}", None, None, i))
    held.write()
    assert state.calls == len(state.map) == 10
    held = O.Waiting(state, False)
    assert n - 1 in held.block(n - 1) and n not in held.block(n) and held.since == n - O.BLOCK and state.calls == 12
    held.put(0, ("user", "0", None, None, 0))
    assert [held.take(i).content for i in range(n)] == [str(i) for i in range(n)] and held.take(n) is None
    held.write()
    assert state.map == {} and state.calls <= 12 + 9 + 10


def test_timers_go_on_for_what_is_left(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put(row("a", 2, "two", 40), row("a", 4, "four", 52), row("a", 6, "six", 60))
    assert [x[3] for x in feed.said()] == ["two"]
    feed.put(row("z", 0, "clock", 65))  # past a's row 4 as well
    feed.put(row("z", 1, "clock", 90))
    assert [(x[2], x[3]) for x in feed.said() if x[0] == "a"] == [(0, "two"), (1, "four"), (2, "six")]


def size(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_snapshots_rewrite_what_they_touch(spark, tmp_path):
    root = f"file://{tmp_path}"
    batch = lambda rows: spark.createDataFrame(rows, "problem_id string, turn_id long, snapshot string")
    latest = lambda: {r[0]: (r[1], r[2]) for r in S.latest(spark, root).collect()}
    assert latest() == {}
    S.upsert(batch([(f"p{i}", 1, "x" * 50 + str(i)) for i in range(300)] + [(None, 1, "nobody")]), root, 0)
    written = []
    for epoch in range(1, 9):
        S.upsert(batch([("p7", 1 + epoch, f"s{epoch}"), ("p8", 0, "older")]), root, epoch)
        written.append(size(f"{tmp_path}/latest/epoch={epoch}"))
    assert latest()["p7"] == (9, "s8") and latest()["p8"] == (1, "x" * 50 + "8") and len(latest()) == 300
    assert max(written) <= min(written) + 200 and max(written) < size(f"{tmp_path}/latest") / 8
    before = latest()
    S.upsert(batch([("p7", 99, "replayed")]), root, 8)
    assert latest() == before and S.history(spark, root).count() == 301 + 16
    assert S.epochs(spark, root) == [6, 7, 8]
    assert sorted(int(x.rpartition("=")[2]) for x in glob.glob(f"{tmp_path}/latest/epoch=*") if glob.glob(f"{x}/bucket=*")) == [0, 6, 7, 8]


def test_an_epoch_broken_off_is_run_again(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    batch = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two"), ("b", 1, None)], "problem_id string, turn_id long, snapshot string")
    S.upsert(batch, root, 0)
    with monkeypatch.context() as m:
        m.setattr(S, "json", SimpleNamespace(loads=json.loads, dumps=lambda *_: 1 / 0))
        with pytest.raises(ZeroDivisionError):
            S.upsert(spark.createDataFrame([("a", 3, "three")], batch.schema), root, 1)
    assert sorted(tuple(r) for r in S.latest(spark, root).collect()) == [("a", 2, "two"), ("b", 1, None)]
    S.upsert(spark.createDataFrame([("a", 3, "three")], batch.schema), root, 1)
    assert {r[0]: r[2] for r in S.latest(spark, root).collect()} == {"a": "three", "b": None} and S.history(spark, root).count() == 4
    S.upsert(batch.limit(0), root, 2)
    assert S.latest(spark, root).count() == 2
