"""Merging, selection, budgets, sources, sinks, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from credence.api import Memory
from credence.operators import budget, graph as G, merge as M, nodes as N, relations as R, retrieval as RT, selection as SEL, turns as T, usage as U
from credence.sources import benchmarks, items, logs, sinks

NODE = "item_id string, id long, node_type string, text string, turn_id long, confidence double, extraction_method string, query string, tool_result_items array<struct<title:string,snippet:string>>"
EDGE = "item_id string, id long, from_id long, to_id long, type string, weight double"


def nodes(spark, rows):
    return spark.createDataFrame([("a", i, "belief", t, turn, 0.8, m, q, None) for i, t, turn, m, q in rows], NODE)


def test_all_fit(spark):
    n = nodes(spark, [(1, "one", 2, None, None), (2, "two", 3, None, None)])
    e = spark.createDataFrame([("a", 7, 1, 2, "depends_on", 1.0)], EDGE)
    s = RT.similarities(RT.units(n), spark.createDataFrame([("a", "query", "one")], "item_id string, query string, text string"))
    got = SEL.select(n, e, s, "connected", 1000).collect()
    assert [x["id"] for x in got] == [1, 2] and got[0]["strategy"] == "all_fit"


def test_chain_is_kept_and_budget_holds(spark):
    filler = " filler" * 20
    n = nodes(spark, [(1, "target fact base" + filler, 3, None, None), (2, "target middle" + filler, 4, None, None), (3, "target end" + filler, 5, None, None), (5, "nothing of use here" + " zzz" * 60, 3, None, None)])
    e = spark.createDataFrame([("a", 11, 3, 2, "depends_on", 1.0), ("a", 12, 2, 1, "depends_on", 1.0)], EDGE)
    q = spark.createDataFrame([("a", k, "target" + filler) for k in ("query", "focus", "question", "c1")], "item_id string, query string, text string")
    s = RT.similarities(RT.units(n), q)
    for strategy, edges in (("connected", e), ("focused", R.coherent(e, n))):
        got = SEL.select(n, edges, s, strategy, 700).collect()
        assert {x["id"] for x in got} == {1, 2, 3} and sum(x["cost"] for x in got) <= 700
    assert {x["id"] for x in R.induced(e, n.filter("id < 4")).collect()} == {11, 12}


def test_eligible_and_constraints(spark):
    n = nodes(spark, [(1, "pinned", 1, None, None), (2, " ", 3, None, None), (3, "The web_search tool returned no results.", 3, None, None), (4, "kept", -1, None, None), (5, "Pinned", 1, None, None), (6, "Use web_search first", 1, None, None)]).withColumn("role", F.lit("user"))
    assert [x["id"] for x in N.eligible(n).collect()] == [4]
    c = N.question_constraints(n)
    assert [x["text"] for x in c.collect()] == ["pinned"]
    q = spark.createDataFrame([("a", "q?"), ("b", "other?")], "item_id string, question string")
    assert {(x["item_id"], x["text"]) for x in N.constraints_or_question(c, q).collect()} == {("a", "pinned"), ("b", "other?")}


def test_greedy_skips_and_excerpt_stops(spark):
    rows = spark.createDataFrame([("a", 1, "fact", 3.0, 1, 50), ("a", 2, "fact", 2.0, 1, 60), ("a", 3, "fact", 1.0, 1, 40)], "item_id string, id long, kind string, score double, turn_id long, cost long")
    assert budget.greedy(rows, {"fact": 100}).first()["ids"] == [1, 3]
    s = spark.createDataFrame([("a", 1, "x" * 60), ("a", 2, "y" * 200), ("a", 3, "z")], "item_id string, seq long, section string")
    assert budget.until_full(s, 160).first()["text"] == "x" * 60 + "\n\n" + "y" * 97 + "…"
    assert budget.until_full(s, 100).first()["text"] == "x" * 60


def test_components_and_incremental_anchor(spark):
    n = spark.range(6).toDF("id")
    e = spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "a long, b long")
    assert {x["id"]: x["comp"] for x in G.components(n, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
    p = spark.createDataFrame([(1, 10, 0.9), (2, 10, 0.95), (10, 11, 0.9), (3, 12, 0.8)], "a long, b long, similarity double")
    new = spark.createDataFrame([(i, i >= 10) for i in (1, 2, 3, 10, 11, 12, 13)], "id long, is_new boolean")
    assert {x["id"]: x["group_id"] for x in M.groups(p, new).collect()} == {2: 2, 10: 2, 11: 2, 3: 3, 12: 3}


def test_mixed_groups_are_skipped_whole(spark):
    n = spark.createDataFrame([(1, "s", "q", None), (2, "s", "r", None), (3, None, None, None), (4, None, None, None)], "id long, tool_name string, query string, tool_arguments string")
    m = spark.createDataFrame([(1, 1), (1, 2), (3, 3), (3, 4)], "group_id long, id long")
    assert {x["id"] for x in M.gated(m, n).collect()} == {3, 4}


def test_merge_is_idempotent(spark):
    rows = [("a", i, "belief", "user", t, 1, [i], [], [], None, None, None, [x, 1 - x], 0.8) for i, t, x in ((1, "old", 1.0), (2, "new", 1.0), (3, "far", 0.0))]
    n = spark.createDataFrame(rows, "item_id string, id long, node_type string, role string, text string, turn_id long, evidence_ids array<long>, merged_from array<long>, entities array<string>, extraction_method string, query string, tool_arguments string, vector array<double>, confidence double").withColumn("tool_name", F.lit(None).cast("string")).withColumn("active", F.lit(True))
    e = spark.createDataFrame([("a", 1, 1, 2, "depends_on", 1.0), ("a", 2, 2, 3, "depends_on", 1.0)], EDGE)
    kept, edges, merged = M.merge_pass(n, e, 0.9)
    assert {x["id"] for x in kept.collect()} == {1, 3} and [(x["from_id"], x["to_id"]) for x in edges.collect()] == [(1, 3)]
    assert merged.first()["evidence_ids"] == [1, 2]
    assert M.similar_pairs(kept, 0.9).isEmpty()


def test_small_groups_merge(spark):
    rows = spark.createDataFrame([("t", i, d, g) for i, d, g in ((0, 0.1, 0), (1, 0.9, 0), (2, 0.5, 1), (3, 0.1, 2), (4, None, 2))], "text_id string, index int, distance double, group long")
    assert [x["group"] for x in RT.without_small_groups(rows, 2).orderBy("index").collect()] == [0, 0, 1, 1, 1]


def test_sessions_sort_only_if_all_dates_parse(spark):
    def turns(dates, **k):
        row = ("q", [[{"role": "user", "content": "b"}], [{"role": None, "content": None}, {"role": "assistant", "content": "a"}]], dates)
        df = spark.createDataFrame([row], f"item_id string, sessions array<array<{items.MESSAGE}>>, dates array<string>").withColumn("trajectory", F.lit(None).cast(f"array<{items.MESSAGE}>")).withColumn("messages", F.col("trajectory"))
        return [(x["turn_id"], x["role"], x["content"]) for x in items.turns(df, **k).orderBy("turn_id").collect()]

    assert turns(["2023/05/20 (Sat) 10:00", "2023/05/19 (Fri) 10:00"]) == [(0, "user", ""), (1, "assistant", "a"), (2, "user", "b")]
    kept = [(0, "user", "b"), (1, "user", ""), (2, "assistant", "a")]
    assert turns(["2023/05/20 10:00", "soon"]) == turns(["2023/05/20"]) == turns(["2023/05/20 10:00", "2023/05/19 10:00"], keep_order=True) == kept


@pytest.mark.parametrize("doc, n", [({"trajectory": [{"role": "user", "content": "x"}]}, 1), ([{"role": "user", "content": "x"}], 1), ({"messages": [{"content": "x"}]}, 1), ([{"question_id": "q1", "sessions": [[{"content": "x"}]]}, {"item_id": "i2", "sessions": [[{"content": "y"}]]}], 2)])
def test_item_shapes(spark, tmp_path, doc, n):
    (tmp_path / "x.json").write_text(json.dumps(doc))
    got = items.read_items(spark, str(tmp_path))
    assert got.count() == n and items.turns(got).count() == n
    assert items.select_item(got, "0").count() == 1


def test_benchmarks(spark, tmp_path):
    (tmp_path / "mmlu_pro.jsonl").write_text(json.dumps({"question_id": 7, "question": "Q?", "options": ["x", "y"], "answer": "y", "category": "c"}) + "\n")
    x = benchmarks.load(spark, "mmlu_pro", str(tmp_path)).first()
    assert x["answers"] == ["B"] and x["question"] == "Q?\nA. x\nB. y" and x["metadata"] == {"category": "c"}
    (tmp_path / "b.jsonl").write_text(json.dumps({"task_id": "t", "input": "Q", "ground_truth_answer": '["a", "b"]'}) + "\n")
    assert benchmarks.browsecomp(benchmarks.read_rows(spark, str(tmp_path / "b.jsonl"))).first()["answers"] == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        benchmarks.load(spark, "gaia", str(tmp_path))
    g = spark.createDataFrame([("1", "Q", "3", "1", {"Tools": "1. Image recognition"}), ("2", "Q", "4", "1", {"Tools": "search"})], "task_id string, Question string, `Final answer` string, Level string, `Annotator Metadata` struct<Tools:string>")
    assert [x["task_id"] for x in benchmarks.gaia(g, 1, text_only=True).collect()] == ["2"]


def test_logs(spark, tmp_path):
    d = tmp_path / "s" / "model-io"
    d.mkdir(parents=True)
    (d / "a.jsonl").write_text('{"call_id": 1, "type": "request", "n": 1}\nnot json\n{"call_id": 1, "type": "response"}\n{"call_id": 1, "type": "request", "n": 2}\n')
    x = logs.assembled_traces(logs.trace_files(spark, str(tmp_path))).first()
    assert '"n": 2' in x["request"] and x["response"] and x["error"] is None
    assert '"n": 2' in logs.last_snapshot(logs.lines(spark, str(d))).first()["value"]
    body = json.dumps({"answerBox": {"answer": "42", "link": "http://a"}, "organic": [{"title": "t", "link": "http://a", "snippet": "42"}, {"title": "u", "link": "http://b", "snippet": "s"}]})
    got = logs.search_evidence(spark.createDataFrame([(1, body)], "query_id long, body string")).orderBy("rank").collect()
    assert [(x["rank"], x["kind"], x["url"]) for x in got] == [(1, "answer", "http://a"), (2, "organic", "http://b")]


def test_sinks_and_memory(spark, tmp_path):
    n = nodes(spark, [(1, "Tea is good", 2, None, None), (2, "Bob codes", 3, None, None)]).withColumn("active", F.lit(True))
    r = spark.createDataFrame([("a", 7, 1, 2, "depends_on", 1.0), ("a", 8, 1, 2, "contradicts", 1.0)], EDGE)
    ev = spark.createDataFrame([("a", 1, "t")], "item_id string, id long, text string")
    assert len(sinks.write_artifacts(str(tmp_path / "out"), n, ev, r)) == 8
    doc = json.loads(sinks.memory_document(n, r).first()["document"])
    assert doc["counts"] == {"beliefs": 2, "decisions": 0, "forward": 1, "backward": 1}
    m = Memory(n, r, ev)
    assert [x["id"] for x in m.believe("TEA").collect()] == [1] and m.relation_view("contradicts").count() == 1


def test_scored(spark):
    rows = [("1", "hotpotqa", "FINAL ANSWER: the Eiffel Tower", ["x", "Eiffel Tower"]), ("2", "mmlu_pro", "The answer is (J).", ["j"]), ("3", "gaia", "ANSWER: $1,234", ["1234"]), ("4", "gaia", "ANSWER: 5", [])]
    got = {x["task_id"]: (x["correct"], x["score"]) for x in U.scored(spark.createDataFrame(rows, "task_id string, benchmark string, response string, answers array<string>")).collect()}
    assert got == {"1": (True, 1.0), "2": (True, 1.0), "3": (True, 1.0), "4": (False, 0.0)}


def test_session_machine(spark, tmp_path):
    from credence.streaming.sessions import sessions

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("p", "user", "he", False, None, 1), ("p", "user", "llo", True, None, 2), ("p", "system", "x", None, None, 3), ("p", "function", "r", False, None, 4), ("p", "assistant", "bye", None, True, 5), ("p", "user", "late", None, None, 6)]
    src = spark.createDataFrame(rows, "problem_id string, role string, content string, is_message_end boolean, is_trajectory_end boolean, recv_index long")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sessions(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(x["kind"], x["turn_id"], x["role"], x["content"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [("message", 0, "user", "hello"), ("skipped", 1, "system", "x"), ("message", 2, "tool", "r"), ("message", 3, "assistant", "bye"), ("finalized", 4, None, None), ("rejected", None, "user", "late")]


def test_recent_steps_keep_batches_whole(spark):
    s = spark.createDataFrame([("s", 1, 1, True), ("s", 2, 2, True), ("s", 3, 2, True), ("s", 4, 3, False)], "session string, seq long, batch long, complete boolean")
    assert [x["seq"] for x in T.recent_steps(s, 1).orderBy("seq").collect()] == [2, 3, 4]
