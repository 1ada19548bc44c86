"""Chunks, paths, settings and axes on small tables, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from credence.functions import text as X, vectors as V
from credence.operators import chunks, graph, settings, turns, usage

CALL = '<tool_call>{"name": "a"}</tool_call>'


def test_every_call_is_a_chunk_of_its_own(spark):
    texts = [(1, f"One here. Two here.\n{CALL}  {CALL} Then three. "), (2, "No call. At all."), (3, CALL), (4, "  "), (5, f"<b></b>{CALL}")]
    rows = chunks.chunked(spark.createDataFrame(texts, "text_id long, content string")).orderBy("text_id", "chunk_id").collect()
    content = dict(texts)
    assert all(content[r["text_id"]][r["start"] : r["end"]] == r["text"] and r["text"] == r["text"].strip() for r in rows)
    assert [(r["text_id"], r["chunk_id"], r["kind"], r["text"]) for r in rows] == [
        (1, 0, "text", "One here. Two here."), (1, 1, "tool_call", CALL), (1, 2, "tool_call", CALL), (1, 3, "text", "Then three."), (2, 0, "text", "No call. At all."), (3, 0, "tool_call", CALL), (5, 0, "text", "<b></b>"), (5, 1, "tool_call", CALL),
    ]


def test_text_between_calls_is_cut_by_meaning(spark):
    words = lambda w, n: " ".join(f"{w} {w} {w} {w}." for _ in range(n))
    text = words("apple", 4) + " " + words("zebra", 4)
    rows = chunks.chunked(spark.createDataFrame([(1, f"{CALL} {text}")], "text_id long, content string"), V.hashing_embedder(), 80.0, 0).orderBy("chunk_id").collect()
    assert [r["text"] for r in rows] == [CALL, words("apple", 4), words("zebra", 4)] and [r["sentences"] for r in rows] == [0, 4, 4]


def test_paths_of_any_depth(spark):
    n = 3000
    entries = spark.createDataFrame([("s", i, i - 1 if i else None) for i in range(n)] + [("t", 0, 99), ("t", 1, 0)], "session string, id long, parent_id long")
    leaves = spark.createDataFrame([("s", n - 1), ("s", 5), ("t", 1), ("u", 3)], "session string, id long")
    got = graph.path_to_root(entries, leaves).groupBy("session", "leaf").agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.sum(F.col("id") + F.col("depth")).alias("s")).collect()
    assert {(r["session"], r["leaf"], r["n"], r["d"], r["s"]) for r in got} == {("s", n - 1, n, n - 1, n * (n - 1)), ("s", 5, 6, 5, 30), ("t", 1, 2, 1, 2)}
    with pytest.raises(ValueError):
        graph.path_to_root(spark.createDataFrame([("s", 0, 1), ("s", 1, 0)], "session string, id long, parent_id long"), spark.createDataFrame([("s", 0)], "session string, id long"))


def test_paths_over_runs(spark, monkeypatch):
    rng = random.Random(3)
    entries = [("s", i, i - 1 if i and i % 50 else rng.randrange(i) if i else None) for i in range(1000)] + [("r", i, i + 1) for i in range(20)] + [("x", 1, None), ("x", 2, 1), ("x", 5, 2), ("x", 5, 1), ("x", 6, 5)]
    parents = {}
    for s, i, p in entries:
        parents.setdefault((s, i), []).append(p)
    leaves = [("s", 999), ("s", 999), ("s", 437), ("s", 50), ("s", 0), ("r", 0), ("x", 6), (None, 1)]

    def paths(s, leaf):
        front, out, d = [leaf], [], 0
        while front:
            out += [(s, leaf, i, d) for i in front]
            front, d = [p for i in front for p in parents[s, i] if (s, p) in parents], d + 1
        return out

    written = []
    plain = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append((name, out := plain(df, name))) or out)
    rows = spark.createDataFrame(entries, "session string, id long, parent_id long")
    got = graph.path_to_root(rows, spark.createDataFrame(leaves, "session string, id long"))
    assert sorted(map(tuple, got.collect())) == sorted(x for s, i in set(leaves) if s for x in paths(s, i))
    # chains of entries aren't doubled: rounds see runs alone
    assert all(df.count() <= 200 for name, df in written if name != "runs")


def test_settings_in_layers(spark):
    rows = [(0, "base", "a.b", "1"), (0, "base", "a.c", "2"), (0, "base", "d", "3"), (0, "base", "e.f", "4"), (1, "user", "a.b", "5"), (1, "user", "d", None), (1, "user", "e", "6"), (2, "cli", "d.x", "7")]
    got = settings.layered(spark.createDataFrame(rows, "layer int, source string, path string, value string")).collect()
    assert sorted(map(tuple, got)) == [("a.b", "5", "user"), ("a.c", "2", "base"), ("d.x", "7", "cli"), ("e", "6", "user")]


def test_axes_and_lists(spark):
    rows = spark.createDataFrame([("p", 35388.39), ("p", 10.0), ("q", 7.0), ("r", 0.5)], "panel string, v double")
    got = {r["panel"]: (r["top"], r["step"], len(r["ticks"])) for r in usage.axes(rows, "panel", "v").collect()}
    assert got["p"] == (40000.0, 10000.0, 5) and got["q"] == (8.0, 2.0, 5) and got["r"][0] == pytest.approx(0.6)
    one = spark.createDataFrame([(["3", "x", "3", " 4", None, "2.5"],), (None,)], "v array<string>")
    assert [r[0] for r in one.select(X.int_list(F.col("v"))).collect()] == [[3, 4], []]
    pairs = spark.createDataFrame([("i", 1, 10), ("i", 2, 11), ("i", 3, 12)], "item_id string, result_id long, call_id long")
    calls = spark.createDataFrame([("i", 10, "q"), ("i", 11, " ")], "item_id string, call_id long, query string")
    assert {r["result_id"]: r["query"] for r in turns.result_queries(pairs, calls).collect()} == {1: "q", 2: None, 3: None}
