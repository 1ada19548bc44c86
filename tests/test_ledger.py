import pyarrow as pa
import pytest

from credence.operators import ledger as L

SCHEMA = "label string, prompt string"


def fake():
    def model(batch):
        """Prompts say what happens: fK fails K times, oK answers in K tokens at most, bad never succeeds."""
        status, answers = [], []
        for r in batch.to_pylist():
            word, k = r["prompt"].split()[0], r["attempt"]
            kind = word[0]
            ok = k > int(word[1:]) if kind == "f" else r["limit"] <= int(word[1:]) if kind == "o" else kind == "x"
            status.append("ok" if ok else "overflow" if kind == "o" else None if word == "null" else "failed")
            answers.append(f"{batch.num_rows}")
        return pa.RecordBatch.from_pydict({"status": pa.array(status, pa.string()), "answer": answers})

    return model  # workers can't import this module, so it goes to them whole


def run(spark, rows, root, **options):
    requests = spark.createDataFrame(rows, SCHEMA)
    said = L.ask(requests, fake(), root, **options)
    return {r["prompt"]: r for r in L.digested(requests).join(said, "digest", "left").collect()}


def test_rounds(spark, tmp_path):
    rows = [("a", "x"), ("a", "x"), ("b", "x"), ("a", "f2"), ("a", "f9"), ("a", "o100"), ("a", "o5"), ("a", "bad"), ("a", "null"), ("a", None), (None, "x y")]
    root = f"file://{tmp_path}/l"
    got = run(spark, rows, root, retries=4)
    assert {k: (r["status"], r["attempts"], r["limit"]) for k, r in got.items()} == {
        "x": ("ok", 1, 256), "f2": ("ok", 3, 256), "f9": ("failed", 4, 256), "o100": ("ok", 3, 64), "o5": ("overflow", 4, 32), "bad": ("failed", 4, 256), "null": ("failed", 4, 256), None: (None, None, None), "x y": ("ok", 1, 256),
    }
    asked = [r for k in range(1, 5) for r in spark.read.schema(L.ROUND).parquet(f"{root}/round={k}").collect()]
    ok = {r["digest"]: r["attempt"] for r in asked if r["status"] == "ok"}
    assert not [r for r in asked if r["attempt"] > ok.get(r["digest"], 99)] and len(asked) == len({(r["digest"], r["attempt"]) for r in asked})
    assert run(spark, rows, root, retries=12)["o5"]["attempts"] == 5 and run(spark, rows, root, retries=12)["f9"]["status"] == "ok"


def test_a_run_broken_off_goes_on(spark, tmp_path):
    root, rows = f"file://{tmp_path}/l", [("a", "x"), ("a", "f1"), ("a", "f2")]
    run(spark, rows, root, retries=1)
    (tmp_path / "l" / "round=2").mkdir()
    (tmp_path / "l" / "round=2" / "half").write_text("not whole")
    got = run(spark, rows, root)
    assert {k: r["attempts"] for k, r in got.items()} == {"x": 1, "f1": 2, "f2": 3}


@pytest.mark.parametrize("budget, largest", [(1, 1), (3, 3), (10**6, 10**6)])
def test_batches_keep_their_budget(spark, tmp_path, budget, largest):
    rows = [("a", f"x {i:02}") for i in range(40)]  # a token each
    got = run(spark, rows, f"file://{tmp_path}/l", budget=budget)
    sizes = [int(r["answer"]) for r in got.values()]
    assert max(sizes) <= largest and (budget == 1 or max(sizes) > 1)


def test_prepared(spark):
    call = '<tool_call>{"id": "c", "name": "web_search", "arguments": {"query": "q"}}</tool_call>'
    turns = [("i", 0, "user", "u"), ("i", 1, "assistant", "think"), ("i", 2, "tool", "r1"), ("i", 3, "tool", "r2"), ("i", 5, "assistant", call), ("i", 6, "tool", "r3"), ("j", 0, "tool", None)]
    df = spark.createDataFrame(turns, "item_id string, turn_id long, role string, content string")
    plan = L.prepared(df, most_semantic=2)
    assert sorted(tuple(r) for r in plan.collect()) == [("i", 1, "assistant", 1, 0), ("i", 2, "tools", 2, 0), ("i", 3, "tools", 2, 1), ("i", 5, "rule", 5, 0), ("i", 6, "rule", 6, 0), ("j", 0, "tools", 0, 0)]
    assert {(r["item_id"], r["batch"]): r["prompt"] for r in L.batch_requests(df, plan).collect()} == {("i", 1): "[0] think", ("i", 2): "[0] r1\n[1] r2", ("j", 0): "[0] "}


def test_nothing_to_ask(spark, tmp_path):
    assert L.ask(spark.createDataFrame([("a", None)], SCHEMA), fake(), f"file://{tmp_path}/l").isEmpty()
