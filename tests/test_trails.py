import numpy as np
import pytest

from credence.operators import trails as TR
from credence.sources import logs as L

SCHEMA = "item_id string, id long, from_id long, to_id long, priority int"


def walked(spark, rows):
    out = TR.trails(spark.createDataFrame(rows, SCHEMA)).collect()
    found = {}
    for r in out:
        found.setdefault((r["item_id"], r["trail"]), {})[r["place"]] = r["id"]
    assert all(sorted(v) == list(range(len(v))) for v in found.values())
    return {k: [v[i] for i in range(len(v))] for k, v in found.items()}


@pytest.mark.parametrize("seed", range(3))
def test_each_relation_in_one_trail(spark, seed):
    """Random graphs, with rings, loops and nodes that many relations share."""
    rng = np.random.default_rng(seed)
    n, nodes = 150, [8, 60, 400][seed]
    rows = [("ab"[i % 2], i, int(a), int(b), int(p)) for i, (a, b, p) in enumerate(zip(rng.integers(0, nodes, n), rng.integers(0, nodes, n), rng.integers(0, 3, n)))]
    got = walked(spark, rows)
    ends = {(x[0], x[1]): x[2:4] for x in rows}
    assert sorted(i for v in got.values() for i in v) == list(range(n))
    for (item, first), ids in got.items():
        assert ids[0] == first and all(ends[item, a][1] == ends[item, b][0] for a, b in zip(ids, ids[1:]))
    # what could follow one another does: at no node do a trail's end and a path's begin meet
    lasts = {(item, ends[item, v[-1]][1]) for (item, _), v in got.items() if ends[item, v[-1]][1] != ends[item, v[0]][0]}
    begins = {(item, ends[item, v[0]][0]) for (item, _), v in got.items() if ends[item, v[-1]][1] != ends[item, v[0]][0]}
    assert not lasts & begins


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    tables = []
    cut = TR.cut
    monkeypatch.setattr(TR, "cut", lambda df, name: tables.append(name) or cut(df, name))
    order = np.random.default_rng(0).permutation(10_000)
    rows = [("a", int(order[i]), i, i + 1, 0) for i in range(10_000)]
    got = walked(spark, rows)
    assert got == {("a", int(order[0])): order.tolist()} and tables.count("trails") <= 16


def test_edges(spark):
    rows = [("a", 1, 1, 1, 0), ("a", 2, 5, None, 0), ("a", 3, None, 5, 0), ("a", 4, 7, 8, 0), ("a", 4, 7, 8, 0), ("a", 5, 8, 9, 0), ("b", 6, 9, 8, 0)]
    assert walked(spark, rows) == {("a", 1): [1], ("a", 3): [3, 2], ("a", 4): [4, 5], ("b", 6): [6]}
    assert walked(spark, []) == {}


@pytest.mark.parametrize("most", [2, 1000])
def test_all_timings(spark, most):
    line = lambda p, **more: "{" + ", ".join(f'"{k}": "{v}"' for k, v in {"problem_id": p, **more}.items()) + "}"
    rows = [("old", 1, 5, line("p1")), ("new", 1, 9, line("p10", note="p1")), ("new", 2, 9, line("p1", x=1)), ("new", 3, 9, line("p1")), ("new", 4, 9, '{"problem_id": "p2"'), ("old", 2, 5, line("p2")), ("old", 3, 5, None), ("old", 4, 5, line("p é"))]
    df = spark.createDataFrame(rows, "path string, line_no long, modified long, value string")
    problems = spark.createDataFrame([(x,) for x in ("p1", "p2", "p10", "p é", "none", "", None, "p1")], "problem_id string")
    got = {r["problem_id"]: (r["path"], r["line_no"]) for r in L.find_all_timings(df, problems, most).collect()}
    assert got == {"p1": ("new", 2), "p10": ("new", 1), "p2": ("old", 2), "p é": ("old", 4)}
    assert L.find_all_timings(df, problems.limit(0)).isEmpty()
