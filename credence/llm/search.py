"""Exact top-k inner-product search by norm-bucketed retrieval.

Vectors are dealt out by length (Euclidean norm), so that a task holds neighbours in length, and each task cuts its
run into buckets of at most BUCKET vectors in order of falling length. For a query q whose k-th best score so far is
t, a vector p can only enter if |q||p| cos(q, p) >= t. So a bucket whose greatest length l gives the local cosine
threshold t / (|q| l) > 1 is skipped whole. Else the bucket is pruned in one of two ways, chosen for each query from
that local threshold c:

* length: only the bucket's prefix of vectors with |p| >= t / |q| remains;
* coordinate, if c >= COORDINATE_FROM: with f the query's largest coordinate, a unit vector within cosine c of q has
  its f-th coordinate between q_f c - s and q_f c + s, s = sqrt((1 - c^2)(1 - q_f^2)); the bucket's list sorted by f
  gives the range.

What remains is verified by products in exact integers. Queries go out in blocks of QUERY_BLOCK, one after the other, so
what is broadcast at a time is bounded (QUERY_BLOCK * dimensions * 8 bytes), with first thresholds from scores against
the longest SEEDS vectors.

Null and short cases: a vector that is null, empty, or holds null, NaN or infinite components takes no part, as query or candidate;
vectors of unequal dimension meet as if padded with zeros; ties go to the smaller id; repeated rows are candidates
each, but no candidate has the query's own id; a query id with several vectors asks with the smallest of them; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from credence.llm.common import materialise, table_path

BUCKET = 2048
QUERY_BLOCK = 8192
SEEDS = 64
COORDINATE_FROM = 0.7
#: Integer products and sums below this are exact in float64.
EXACT = 2.0**53


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """id, components floor(scale * x) as longs, their norm; rows that take no part are left out."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    rows = vectors.filter(ok & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), q.alias("q"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))


def _matrix(column: pa.ListArray, dim: int | None = None) -> np.ndarray:
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    width = dim if dim is not None else int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    if len(sizes) and (sizes == width).all():
        out[:] = flat[offsets[0] : offsets[-1]].reshape(len(sizes), width)
    else:
        for i, (a, n) in enumerate(zip(offsets[:-1], sizes)):
            out[i, : min(n, width)] = flat[a : a + min(n, width)]
    return out


def _scores(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products as int64: by floating point where that is exact."""
    high = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * q.shape[-1]
    if high < EXACT:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    return q @ p.T


class _Best:
    """The k best (score, -id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.astype(np.float64)  # floor: a proven lower bound of the k-th best score
        self.rows: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(n)]

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, v = self.rows[i]
        s, v = np.concatenate([s, score]), np.concatenate([v, ids])
        if len(s) > self.k:
            keep = np.lexsort((v, -s))[: self.k]
            s, v = s[keep], v[keep]
        self.rows[i] = s, v
        if len(s) == self.k:
            self.floor[i] = max(self.floor[i], float(s[-1] if len(s) < self.k else s.min()))


def search_bucket_run(ids: np.ndarray, p: np.ndarray, norms: np.ndarray, qids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int, stats: dict | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k best of one run of vectors for each query, given lower bounds of each query's k-th best score."""
    order = np.argsort(-norms, kind="stable")
    ids, p, norms = ids[order], p[order], norms[order]
    qn = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    best = _Best(len(qids), k, floors)
    for a in range(0, len(ids), BUCKET):
        pi, pv, pn = ids[a : a + BUCKET], p[a : a + BUCKET], norms[a : a + BUCKET]
        longest = pn[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(qn * longest > 0, best.floor / (qn * longest), np.where(best.floor > 0, np.inf, -np.inf))
        live = np.flatnonzero(local <= 1 + 1e-9)
        by_coordinate = live[local[live] >= COORDINATE_FROM]
        by_length = live[local[live] < COORDINATE_FROM]
        if len(by_coordinate):
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = np.where(pn[:, None] > 0, pv / pn[:, None], 0.0)
            lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for i in by_coordinate:
                u = q[i] / qn[i]
                f, c = int(np.abs(u).argmax()), min(1.0, local[i])
                if f not in lists:
                    o = np.argsort(unit[:, f], kind="stable")
                    lists[f] = o, unit[o, f]
                o, xs = lists[f]
                # The bound is for c over the longest vector; a shorter one needs a higher cosine, so it holds for all.
                slack = np.sqrt(max(0.0, (1 - c * c) * (1 - u[f] * u[f]))) + 1e-9
                lo, hi = np.searchsorted(xs, u[f] * c - slack, "left"), np.searchsorted(xs, 2.0 if u[f] > 0 and c <= abs(u[f]) else u[f] * c + slack, "right")
                if u[f] < 0 and c <= abs(u[f]):
                    lo, hi = 0, np.searchsorted(xs, u[f] * c + slack, "right")
                sel = o[lo:hi]
                _take(best, i, qids[i], q[i : i + 1], pi[sel], pv[sel])
                if stats is not None:
                    stats["coordinate"] = stats.get("coordinate", 0) + len(sel)
        for b in range(0, len(by_length), 512):
            part = by_length[b : b + 512]
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(qn[part] > 0, best.floor[part] / qn[part], -np.inf)
            n = int((pn >= need.min() - 1e-6).sum())
            s = _scores(q[part], pv[:n])
            for j, i in enumerate(part):
                row = s[j]
                hit = np.flatnonzero((row >= best.floor[i]) & (pi[:n] != qids[i]))
                if len(hit) > 4 * k:  # only the k best can stay; ties at the k-th score all go on
                    kth = np.partition(row[hit], len(hit) - k)[len(hit) - k]
                    hit = hit[row[hit] >= kth]
                best.add(i, row[hit], pi[hit])
            if stats is not None:
                stats["length"] = stats.get("length", 0) + n * len(part)
    return best.rows


def _take(best: _Best, i: int, qid: int, q: np.ndarray, ids: np.ndarray, p: np.ndarray) -> None:
    if len(ids):
        s = _scores(q, p)[0]
        hit = np.flatnonzero((s >= best.floor[i]) & (ids != qid))
        best.add(i, s[hit], ids[hit])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k best other rows."""
    spark = vectors.sparkSession
    rows = materialise(quantise(vectors, id_col, vector_col), "vectors")
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q"))
    n = queries.count()
    schema = "query_id long, vec_id long, score long"
    if n == 0:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score").limit(0)
    seeds = rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "q").toArrow().combine_chunks()
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = rows.repartitionByRange(parts, F.desc("norm"), F.xxhash64("vec_id"))  # runs of like length
    blocks = -(-n // QUERY_BLOCK)
    if blocks == 1:
        return _ranked(buckets.mapInArrow(_searcher(_sent(queries, seeds, k), k), schema), k)
    # Block by block: what is sent is let go before the next one, and each block's results are stored.
    buckets, path = materialise(buckets, "buckets"), table_path(spark, "found")
    for b in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        sent = _sent(mine, seeds, k)
        _ranked(buckets.mapInArrow(_searcher(sent, k), schema), k).write.parquet(f"{path}/block={b}")
        sent.destroy()
    return spark.read.schema(schema + ", rank int").parquet(path).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sent(queries: DataFrame, seeds: pa.Table, k: int):
    """A block of queries with first thresholds, broadcast: QUERY_BLOCK vectors or thereabouts."""
    block = queries.select("vec_id", "q").toArrow().combine_chunks()
    if not block.num_rows:
        return queries.sparkSession.sparkContext.broadcast((np.empty(0, np.int64), np.empty((0, 0), np.int64), np.empty(0)))
    qids, q = block.column("vec_id").chunk(0).to_numpy(), _matrix(block.column("q").chunk(0))
    return queries.sparkSession.sparkContext.broadcast((qids, q, _floors(qids, q, seeds, k)))


def _floors(qids: np.ndarray, q: np.ndarray, seeds: pa.Table, k: int) -> np.ndarray:
    """Lower bounds of each query's k-th best score: its k-th best among the seeds."""
    if seeds.num_rows == 0:
        return np.full(len(qids), -np.inf)
    ids = seeds.column("vec_id").chunk(0).to_numpy()
    s = _scores(q, _matrix(seeds.column("q").chunk(0), q.shape[1])).astype(np.float64)
    s[ids[None, :] == qids[:, None]] = -np.inf
    return np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(qids), -np.inf)


def _searcher(sent, k: int):
    def run(batches):
        qids, q, floors = sent.value
        if not len(qids):
            return
        ids, ps, norms, held = [], [], [], 0
        floors = floors.copy()
        rows = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in qids]

        def flush():
            nonlocal held
            if not held:
                return
            out = search_bucket_run(np.concatenate(ids), np.concatenate(ps), np.concatenate(norms), qids, q, floors, k)
            for i, (s, v) in enumerate(out):
                if len(s):
                    s, v = np.concatenate([rows[i][0], s]), np.concatenate([rows[i][1], v])
                    keep = np.lexsort((v, -s))[:k]
                    rows[i] = s[keep], v[keep]
                    if len(keep) == k:
                        floors[i] = max(floors[i], float(rows[i][0][-1]))
            ids.clear(), ps.clear(), norms.clear()
            held = 0

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column("vec_id").to_numpy(zero_copy_only=False))
                ps.append(_matrix(batch.column("q"), q.shape[1]))
                norms.append(batch.column("norm").to_numpy(zero_copy_only=False))
                held += batch.num_rows
                if held >= 8 * BUCKET:
                    flush()
        flush()
        n = [len(s) for s, _ in rows]
        if sum(n):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qids, n)), pa.array(np.concatenate([v for _, v in rows])), pa.array(np.concatenate([s for s, _ in rows]))], ["query_id", "vec_id", "score"]
            )

    return run


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
