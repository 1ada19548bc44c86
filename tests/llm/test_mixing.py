import numpy as np

from credence.llm import common, mixing as M
from tests.llm.fixtures import awkward, empty


def brute_targets(totals, weights=(5, 2, 1), share=1.5, cap=2.0):
    """The words of the contract, one source at a time."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(totals.values()), set(names), {}
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * unit > cap * totals[s]}
        if not over:
            return out | {s: w[s] * unit for s in free}
        out |= {s: cap * totals[s] for s in over}
        left -= sum(cap * totals[s] for s in over)
        free -= over
    return out


def test_targets_reshare_until_none_is_above(spark):
    rng = np.random.default_rng(3)
    for totals in ({"a": 10, "b": 1000, "c": 500, None: 40}, {"a": 0, None: 0}, {f"s{i}é"[: i % 4 + 1] + str(i): int(x) for i, x in enumerate(rng.lognormal(6, 2, 300))}, {}):
        rows = [(s, 1, n) for s, n in totals.items()]
        got = {r["source"]: r["target"] for r in M.targets(spark.createDataFrame(rows, "source string, n long, total long")).collect()}
        want = brute_targets(totals)
        assert got.keys() == want.keys() and all(np.isclose(got[s], want[s], rtol=1e-9) for s in want)
        assert all(got[s] <= 2 * n + 1e-9 for s, n in totals.items())


def corpus(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.lognormal(4, 1)), ("big", "mid", "small", None)[min(3, i % 7)], 1) for i in range(1500)]
    rows += [(2000 + i, "same words here", "big", 1) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")


def test_taken_words_meet_the_targets(spark):
    docs = corpus(spark)
    rows = M.copies(docs).collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, M.copies(docs).collect()))
    by: dict = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        x = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        x[0] += r["taken"]
        x[1] += r["size"]
    want = brute_targets({s: x[1] for s, x in by.items()})
    for s, (taken, size, target, source_size) in by.items():
        assert size == source_size and abs(target - want[s]) < 1e-6 * max(1, target) and abs(taken - target) <= max(2, 0.002 * target)
    assert abs(sum(want.values()) - 1.5 * sum(x[1] for x in by.values())) < 1e-3


def test_rates_are_tilted_as_an_independent_solver_has_them(spark):
    rows = [("a", 1, 30), ("a", 5, 10), ("a", 50, 2), ("b", 7, 9), ("c", 3, 4), ("c", 30, 4), ("d", 0, 5), ("d", 2, 5), (None, 4, 3), (None, 90, 1)]
    goal = {"a": 0.4 * 180, "b": 1.7 * 63, "c": 2.0 * 132, "d": 1.9999 * 10, None: 1.3 * 102}
    facts = {s: (sum(n for t, _, n in rows if t == s), sum(n * z for t, z, n in rows if t == s)) for s in goal}
    h = spark.createDataFrame(rows, "source string, size long, n long")
    goals = spark.createDataFrame([(s, *facts[s], goal[s]) for s in goal], "source string, n long, total long, target double")
    got = {r["source"]: r for r in M.tilt(h, goals).collect()}
    for s in goal:
        mine = [(z, n) for t, z, n in rows if t == s]
        if s == "c":
            assert got[s]["full"]
            continue
        scale = facts[s][1] / facts[s][0]
        taken = lambda b: sum(n * z * min(2, np.exp(min(b * z / scale, 9))) for z, n in mine)  # noqa: B023, E731
        low, high = -100.0, 100.0
        for _ in range(200):  # bisection
            mid = (low + high) / 2
            low, high = (mid, high) if taken(mid) < goal[s] else (low, mid)
        assert np.isclose(got[s]["b"], low, rtol=1e-5) and np.isclose(taken(got[s]["b"]), goal[s], rtol=1e-6) and abs(got[s]["b"]) > 0.01
    r = [np.exp(got["a"]["b"] * z / got["a"]["scale"]) for z in (1, 5, 50)]
    assert r[0] > r[1] > r[2] and r[0] - r[2] > 0.1


def test_hot_classes_are_dealt_out(spark, monkeypatch):
    docs = corpus(spark)
    want = sorted(map(str, M.copies(docs).select("source", "size", "copies").collect()))
    monkeypatch.setattr(common, "HOT", 0.01)
    assert sorted(map(str, M.copies(docs).select("source", "size", "copies").collect())) == want


def test_rows_of_one_id(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "a b c d", "s"), (2, "x y", "s"), (None, "p q r", None), (None, "p q r", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want: dict = {}
    for r in M.copies(docs).collect():
        k = (r["doc_id"], r["size"])
        want[k] = want.get(k, 0) + r["copies"]
    got: dict = {}
    for r in M.mix_documents(docs).collect():
        k = (r["doc_id"], len(r["text"].split()))
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_many_sources(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', int(id % 17 + 1)) as text", "concat('s', id % 700) as source")
    rows = M.copies(docs).groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect()
    assert len(rows) == 700 and all(abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] for r in rows)


def test_edges(spark):
    docs = awkward(spark)
    got = M.copies(docs).collect()
    assert len(got) == docs.count() and all(r["taken"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    out = M.mix_documents(docs)
    assert out.columns == docs.columns
    assert M.copies(empty(spark)).isEmpty() and M.mix_documents(empty(spark)).isEmpty()
