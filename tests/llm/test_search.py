import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.llm import search


def brute(rows, k, every):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in ok:
        if q % every == 0:
            scored = sorted((-int((x * y).sum()), p) for p, y in ok if p != q)[:k]
            out |= {(q, r, p, -s) for r, (s, p) in enumerate(scored, 1)}
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=8) * (1 + i % 7)]) for i in range(300)]
    rows += [(1000, None), (1001, [float("nan")] * 8), (1002, [None] + [1.0] * 7), (1003, []), (1004, rows[5][1]), (1005, [float("inf")] * 8), (1010, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in search.top_k(df, 5, 10).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows, 5, 10)


def test_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    got = {tuple(r) for r in search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3, 5).collect()}
    assert got == brute(rows, 3, 5)


def test_clashing_columns_unequal_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 2.0], "a", 1.0), (0, [1.0, 2.0], "a", 1.0), (1, [1.0], "b", None), (2, [0.5, 0.5, 4.0], "c", 2.0), (3, [1.0, 2.0], "d", 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q string, norm double").withColumn("score", F.lit("x")).withColumn("rank", F.lit("y"))
    got = search.top_k(df, 5, 50).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, 256 * 256 + 512 * 512), (0, 2, 2, 128 * 256 + 128 * 512), (0, 3, 1, 256 * 256)]


def test_empty(spark):
    assert search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()


@pytest.mark.parametrize("spread", [0.05, 0.3, 5.0])
def test_pruning_loses_nothing(spread, monkeypatch):
    monkeypatch.setattr(search, "BUCKET", 64)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    p = np.floor(256 * (centres[rng.integers(0, 12, 900)] + spread * rng.normal(size=(900, 16))) * rng.uniform(0.2, 3, (900, 1))).astype(np.int64)
    ids, stats = np.arange(900), {}
    q, qids = p[::50], ids[::50]
    found = search.search_bucket_run(ids, p, np.sqrt((p.astype(float) ** 2).sum(1)), qids, q, np.full(len(q), -np.inf), 5, stats)
    for i in range(len(q)):
        s = q[i] @ p.T
        want = sorted((-int(s[j]), int(j)) for j in ids if j != qids[i])[:5]
        assert sorted(zip((-found[i][0]).tolist(), found[i][1].tolist()))[:5] == want
    if spread == 0.05:
        assert stats["coordinate"] > 0  # both ways of pruning were taken
