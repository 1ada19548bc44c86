import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.operators import nodes as N, topk
from credence.operators.numbering import numbered, unused


def test_numbered(spark):
    rng = np.random.default_rng(0)
    rows = [(int(x), int(i)) for i, x in enumerate(rng.integers(0, 50, 3000))]
    df = spark.createDataFrame(rows, "x long, i long")
    got = {r["i"]: r["number"] for r in numbered(df, F.desc("x"), "i").collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert numbered(df.limit(0), "x").isEmpty()


@pytest.mark.parametrize("used", [[], [0], [0, 1, 2, 5, 6, 9, 3000, 3000, -4], [1, 10**12], list(range(0, 4000, 2))])
@pytest.mark.parametrize("n", [0, 1, 2500])
def test_unused(spark, used, n):
    ids = spark.createDataFrame([(u,) for u in used], "id long")
    wanted = spark.range(n).select(F.col("id").alias("number"), (F.col("id") * 7).alias("x"))
    got = {r["x"] // 7: r["id"] for r in unused(ids, wanted).collect()}
    free = (k for k in range(10**6) if k not in set(used))
    assert got == {k: next(free) for k in range(n)}


def test_factors(spark):
    rows = [(None, 3), (1, 0), (None, 1), (4, 9), (None, 12)]
    out = N.factors(spark.createDataFrame(rows, "id long, pos long")).collect()
    assert [(r["pos"], r["id"]) for r in out] == [(1, 0), (0, 1), (3, 2), (12, 3), (9, 4)]


def test_top_nodes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    units = [("ab"[i % 2], int(i // 3), rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(200)]
    units += [("a", 500, None), ("a", 501, [0.0] * 4), ("a", 502, [float("nan")] * 4), ("a", 503, [1.0, 2.0])]
    queries = [("ab"[i % 2], i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(12)] + [("a", 50, None), ("c", 51, [1.0] * 4), ("a", 52, [1.0, 2.0])]
    u = spark.createDataFrame(units, "item_id string, id long, vector array<double>")
    q = spark.createDataFrame(queries, "item_id string, query_id long, vector array<double>")

    def like(a, b):
        norms = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / norms), 9) if len(a) == len(b) and norms else 0.0

    want = {}
    for item, query, v in queries:
        if v is not None:
            scores = {}
            for i, node, x in units:
                if i == item and x is not None and np.isfinite(x).all():
                    scores[node] = max(scores.get(node, -2), like(x, v))
            for rank, (node, s) in enumerate(sorted(scores.items(), key=lambda r: (-r[1], r[0]))[:7], 1):
                want[query, rank] = (node, s)
    for block in (5, topk.BLOCK):
        monkeypatch.setattr(topk, "BLOCK", block)
        got = {(r["query_id"], r["rank"]): (r["id"], round(r["similarity"], 8)) for r in topk.top_nodes(u, q, 7).collect()}
        assert got == {k: (n, round(s, 8)) for k, (n, s) in want.items()}
    assert topk.top_nodes(u.limit(0), q).isEmpty() and topk.top_nodes(u, q.limit(0)).isEmpty()
