import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.operators import merge as M, metric

SCHEMA = "id long, label int, vector array<double>, is_new boolean"
SF = "/root/testdata/sf0.01"


def vectors(seed=0, n=120, dimension=12):
    """Clusters, near copies and noise of any length."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dimension))
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=dimension) * rng.choice([0.05, 0.4, 1.5])
        rows.append((i, i % 2, (v * rng.choice([0.1, 1, 30])).tolist(), i % 3 == 0))
    return rows


ODD = [(200, 0, None, True), (201, 0, [0.0] * 12, True), (202, 0, [1.0, None] + [0.0] * 10, False), (203, 0, [float("nan")] * 12, False), (204, 0, [1.0, 2.0, 3.0], False), (205, 0, [2.0, 4.0, 6.0], True), (206, 1, [1.0, 2.0, 3.0], True), (207, 0, [1.0, 2.0], True)]


def brute(rows, threshold):
    def unit(v):
        return np.array(v) / np.linalg.norm(v) if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else None

    us = [(i, label, unit(v), new) for i, label, v, new in rows]
    return {(a, b): new or fresh for a, la, u, new in us for b, lb, v, fresh in us if a < b and la == lb and u is not None and v is not None and len(u) == len(v) and u @ v >= threshold}


@pytest.mark.parametrize("threshold", [-1.0, 0.2, 0.6, 0.9, 0.99])
def test_against_all_pairs(spark, threshold):
    rows = vectors() + vectors(1)[:1] + ODD
    rows[120] = (120, *rows[0][1:])  # an equal vector
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, threshold)
    got = M.similar_pairs(df, threshold, ("label",)).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == set(want)
    asked = M.similar_pairs(df, threshold, ("label",), incremental=True).collect()
    assert len(asked) == sum(want.values()) and {(r["a"], r["b"]) for r in asked} == {k for k, new in want.items() if new}
    old = {i for i, *_, new in rows if not new}
    met = metric.candidates(df, threshold, ("label",), incremental=True).collect()
    assert not any(r["a"] in old for r in met)


def test_index(spark, tmp_path):
    rows = vectors(3) + ODD
    df = spark.createDataFrame(rows, SCHEMA).drop("is_new")
    index = metric.Index.create(df.filter("id < 40"), f"file://{tmp_path}/index", ("label",), pivots=5)
    index.add(df.filter("id >= 40 and id % 2 = 0"))
    again = metric.Index(spark, f"file://{tmp_path}/index")
    for threshold in (0.3, 0.9):
        got = again.near(df.filter("id >= 40 and id % 2 = 1"), threshold).collect()
        stored = {i for i, *_ in rows if i < 40 or i % 2 == 0}
        want = {tuple(sorted(p)) for p in brute(rows, threshold) if len(stored & set(p)) == 1 and not (set(p) - stored <= set(range(40)))}
        assert len(got) == len(want) and {tuple(sorted((r["id"], r["stored_id"]))) for r in got} == want
    cells = len(glob.glob(f"{tmp_path}/index/vectors/cell=*"))
    assert 2 < cells <= 6 and again.near(df.limit(0), 0.5).isEmpty()


def test_empty(spark):
    assert M.similar_pairs(spark.createDataFrame([], SCHEMA), 0.5, ("label",)).isEmpty()
    assert M.similar_pairs(spark.createDataFrame(ODD[:4], SCHEMA), 0.5, ("label",), incremental=True).isEmpty()


def test_pairs_compared(spark):
    """On vectors without any structure most pairs are ruled out at 0.9; in clusters whole cells are."""
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    all_pairs = v.groupBy("label").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
    assert metric.candidates(v, 0.9, ("label",)).count() < 0.1 * all_pairs
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(10, 64))
    rows = [(i, 0, (centres[i % 10] + rng.normal(size=64) * 0.05).tolist(), False) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    u = metric.units(df, ["id"])
    visits = metric.placed(u, metric.chosen(u), metric.radius(0.9)).selectExpr("avg(size(visits))").first()[0]
    assert visits < 3 and metric.candidates(df, 0.9, ("label",)).count() == 10 * 40 * 39 / 2


@pytest.mark.parametrize("threshold", [0.2, 0.9])
def test_blocks_of_many_tiles(spark, monkeypatch, threshold):
    """Products of tiles, with cells and without, give each pair once."""
    monkeypatch.setattr(metric, "TILE", 16)
    rows = vectors(4, 150) + ODD
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, threshold)
    got = M.similar_pairs(df, threshold, ("label",)).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == set(want)
    asked = M.similar_pairs(df, threshold, ("label",), incremental=True).collect()
    assert len(asked) == sum(want.values()) and {(r["a"], r["b"]) for r in asked} == {k for k, new in want.items() if new}


def test_pairs_of_groups_are_found_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long").mapInArrow(counted, "a long, b long")
    got = {(r["group_id"], r["id"]) for r in M.groups(pairs).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (7, 7), (7, 8)} and seen.value == 3
