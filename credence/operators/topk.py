"""The nodes most like a query by embeddings: blocked products, and top-k lists that are merged.

A node has several units (its text, and what each of its results says), each with a vector; it is as like a query as the
most like of them. Nodes are asked by queries of their item.

Units of an item are dealt into blocks by hash of the node, so a node's units stay together, and queries into blocks of their
own; there are as many as keep a block at BLOCK vectors. Blocks of one item meet; each meeting is one matrix product, of which the
k best nodes of each query are kept. Only these go on, and the lists of a query are merged. So no item is too large for a task, and
pairs are neither written nor sorted.

Nulls and edges: null vectors, and those with null or non-finite components, are no units and no queries; a vector of length 0 has likeness
0 to all; vectors of different dimensions are 0 alike; ties go to the smaller node id; an item of fewer than k nodes has all in
its lists; several rows of a query id are one query of the last vector in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Vectors in a block.
BLOCK = 512


def _valid(rows: DataFrame) -> DataFrame:
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return rows.filter(F.col("vector").isNotNull() & ~bad).withColumn("vector", F.transform("vector", lambda x: x.cast("double")))


def _blocks(rows: DataFrame, key: str, name: str) -> DataFrame:
    """item_id, block and its rows (key, vector)."""
    n = rows.groupBy("item_id").agg(F.ceil(F.count("*") / BLOCK).alias("__n"))
    placed = rows.join(n, "item_id").withColumn("block", F.pmod(F.xxhash64(key), F.col("__n")))
    return placed.groupBy("item_id", "block").agg(F.collect_list(F.struct(F.col(key).alias("key"), "vector")).alias(name)).drop("block")


def _unit_rows(vectors: list[list[float]], dimension: int) -> np.ndarray:
    x = np.array([v if len(v) == dimension else [0.0] * dimension for v in vectors]).reshape(-1, dimension)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def best(units: list[dict], queries: list[dict], k: int) -> list[tuple[int, int, float]]:
    """(query, node, likeness) of the k best nodes of each query; all queries of one dimension at a time."""
    out = []
    nodes, owner = np.unique([u["key"] for u in units], return_inverse=True)
    by = np.argsort(owner, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], np.diff(owner[by]) > 0)))
    for dimension in {len(q["vector"]) for q in queries}:
        asked = [q for q in queries if len(q["vector"]) == dimension]
        products = _unit_rows([units[i]["vector"] for i in by], dimension) @ _unit_rows([q["vector"] for q in asked], dimension).T
        likeness = np.round(np.maximum.reduceat(products, heads, axis=0), 9) + 0.0  # one row a node, by id
        for q, column in zip(asked, likeness.T):
            # the k best, ties to the first rows
            least = np.partition(column, -k)[-k] if len(column) > k else -np.inf
            some = np.flatnonzero(column >= least)
            out += [(q["key"], int(nodes[i]), float(column[i])) for i in some[np.argsort(-column[some], kind="stable")][:k]]
    return out


def top_nodes(units: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """item_id, query_id, id, similarity, rank. units: item_id, id, vector; queries: item_id, query_id, vector."""
    once = _valid(queries).groupBy("item_id", "query_id").agg(F.max("vector").alias("vector"))
    meetings = _blocks(_valid(units).select("item_id", "id", "vector"), "id", "units").join(_blocks(once, "query_id", "queries"), "item_id")
    schema = f"item_id {dict(units.dtypes)['item_id']}, query_id long, id long, similarity double"

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                found = best(b.column("units")[i].as_py(), b.column("queries")[i].as_py(), k)
                q, n, s = zip(*found) if found else ((), (), ())
                item = b.column("item_id").slice(i, 1).take(pa.array([0] * len(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([item, pa.array(q, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.float64())], ["item_id", "query_id", "id", "similarity"])

    lists = meetings.mapInArrow(run, schema)
    place = F.row_number().over(Window.partitionBy("item_id", "query_id").orderBy(F.desc("similarity"), "id"))
    return lists.withColumn("rank", place).filter(F.col("rank") <= k)
