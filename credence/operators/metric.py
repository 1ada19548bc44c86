"""A metric index of unit vectors: pivots, cells, and bounds that rule out most pairs before they are compared.

Unit vectors of likeness t are r = sqrt(2 - 2 t) apart at most. A few pivots, far from one another, are chosen from a bounded
sample. Each vector lies in the cell of its nearest pivot, and is stored with

* far: its distance from that pivot,
* near: its coordinates in the space that the pivots span, and the length of what lies outside it.

A vector visits a cell only if one of its members can be within r: its distance from the pivot must be within r of some
member's distance (triangle inequality), and it may be beyond the border to any other pivot's cell by no more than r. Vectors that
visit a cell are multiplied with its members, tile by tile; the products that may reach t are summed once more in fixed order.
All bounds are necessary conditions, so the result is exact whatever the pivots; they decide its cost alone. (`candidates` also
drops pairs whose `near` are more than r apart, as the map to `near` shortens distances; a product costs less than that bound.)

An `Index` keeps its vectors in folders by cell. What is added later is placed by the same pivots, and a search reads only the
cells that the new vectors visit; stored vectors are never compared with one another.

Nulls and edges: null vectors, and those of length 0 or with null or non-finite components, are in no pair; vectors of another
dimension than the pivots lie in a cell of their own, where only equal dimensions meet; equal vectors are pairs like others; an
empty table has no pivots and no pairs. Several rows of one id are vectors of their own; within a table they are no pair of that id.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from credence.functions import vectors as V
from credence.operators.graph import cut

#: Pivots, and vectors that they are chosen from.
PIVOTS, SAMPLE = 16, 1024
#: Vectors held by a task, vectors multiplied with them at once, pairs handled at once; tasks at most.
TILE, STRIP, HITS, MOST_TASKS = 4096, 256, 1 << 14, 2000
#: Against rounding: bounds give way by so much.
SLACK = 1e-7
#: The cell of vectors that the pivots say nothing about.
ODD = -1

_PLACED = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType()), T.StructField("near", T.ArrayType(T.DoubleType()))])


def radius(threshold: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK


def units(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of `keep` and `u`, the vector at length 1, of rows that have one."""
    n = V.norm(F.col("vector"))
    whole = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")))
    ok = F.col("vector").isNotNull() & whole & (n > 0) & (n < float("inf"))
    return rows.filter(ok).select(*keep, F.transform("vector", lambda x: x.cast("double") / n).alias("u"))


def chosen(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Pivots: of a sample by hash, each next one the farthest from those before. rows: u, of any number; pivots x dimensions."""
    found = [r["u"] for r in rows.orderBy(F.xxhash64("u")).limit(sample).select("u").collect()]
    same = [u for u in found if len(u) == len(found[0])] if found else []
    if not same:
        return np.empty((0, 0))
    x = np.array(same)
    picked = [0]
    least = np.linalg.norm(x - x[0], axis=1)
    while len(picked) < pivots and least.max() > 1e-6:
        picked.append(int(least.argmax()))
        least = np.minimum(least, np.linalg.norm(x - x[picked[-1]], axis=1))
    return x[picked]


def _distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (u @ pivots.T), 0))


def _visits(u: np.ndarray, pivots: np.ndarray, r: float, ranges: np.ndarray) -> list[list[int]]:
    """The cells that can hold a vector within r of each u. ranges: least and greatest distance from its pivot in each cell."""
    products = u @ pivots.T
    d = _distances(u, pivots)
    ok = (d - r <= ranges[:, 1]) & (d + r >= ranges[:, 0])
    apart = np.linalg.norm(pivots[:, None] - pivots[None], axis=2)
    for p in range(len(pivots)):  # members of p's cell are on its side of all borders
        others = apart[p] > 1e-6
        beyond = (products[:, others] - products[:, [p]]) / apart[p][others]
        ok[:, p] &= (beyond <= r).all(1)
    return [np.flatnonzero(x).tolist() for x in ok]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """Which rows have vectors of the first dimension given, and those vectors."""
    u = batch.column("u")
    return pc.list_value_length(u).to_numpy(zero_copy_only=False), u.flatten().to_numpy(zero_copy_only=False), len(u)


def placed(rows: DataFrame, pivots: np.ndarray, visit: float | None = None, ranges: np.ndarray | None = None) -> DataFrame:
    """rows (u and others) with cell, far, near; with `visit`, a radius, also `visits`, an array of cells."""
    dimension = pivots.shape[1]
    basis = np.linalg.qr(pivots.T)[0] if len(pivots) else np.empty((0, 0))
    ranges = np.tile([0.0, 2.0], (len(pivots), 1)) if ranges is None else ranges
    schema = T.StructType([*rows.schema.fields, *_PLACED.fields, *([T.StructField("visits", T.ArrayType(T.IntegerType()))] if visit is not None else [])])

    def run(batches):
        for b in batches:
            lengths, flat, n = _columns(b)
            cell, far, near, visits = np.full(n, ODD), np.zeros(n), [[0.0]] * n, [[ODD]] * n
            fits = np.flatnonzero(lengths == dimension) if len(pivots) else np.empty(0, np.int64)
            if len(fits):
                starts = (np.cumsum(lengths) - lengths)[fits]
                u = flat[starts[:, None] + np.arange(dimension)]
                d = _distances(u, pivots)
                cell[fits] = d.argmin(1)
                far[fits] = d.min(1)
                inside = u @ basis
                outside = np.sqrt(np.maximum(1 - (inside**2).sum(1), 0))
                for i, x in zip(fits.tolist(), np.column_stack([inside, outside]).tolist()):
                    near[i] = x
                if visit is not None:
                    for i, x in zip(fits.tolist(), _visits(u, pivots, visit, ranges)):
                        visits[i] = x
            columns = [*b.columns, pa.array(cell, pa.int32()), pa.array(far), pa.array(near, pa.list_(pa.float64()))]
            columns += [pa.array(visits, pa.list_(pa.int32()))] if visit is not None else []
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def met(asking: DataFrame, stored: DataFrame, r: float, blocks: tuple[str, ...]) -> DataFrame:
    """Pairs of rows of one block (a, ua, na, b, ub, nb and flags) that no bound rules out. asking: visits; stored: cell."""
    left = asking.withColumn("cell", F.explode("visits")).drop("visits", "far")
    left = left.withColumnsRenamed({"id": "a", "u": "ua", "near": "na"})
    right = stored.select(*blocks, "cell", F.col("id").alias("b"), F.col("u").alias("ub"), F.col("near").alias("nb"), *[c for c in stored.columns if c == "other"])
    return left.join(right, [*blocks, "cell"]).filter(_apart("na", "nb") <= r * r)


def _apart(a: str, b: str):
    """The squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def alike(nodes: DataFrame, threshold: float, blocks: tuple[str, ...], incremental: bool = False) -> DataFrame:
    """blocks, a < b and similarity of nodes (id, vector, blocks, and is_new if incremental) that are alike: each pair once."""
    rows = units(nodes, [*blocks, "id", *(["is_new"] if incremental else [])])
    rows = placed(rows, chosen(rows), radius(threshold)).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows, "placed")  # read several times; its row numbers have to last
    stored = rows.withColumn("free", ~F.coalesce("is_new", F.lit(False)) if incremental else F.lit(False))
    found = products(rows.filter("is_new") if incremental else rows, stored, threshold, blocks, "asked" if incremental else "halved")
    return found.select(*blocks, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def products(asking: DataFrame, stored: DataFrame, threshold: float, blocks: tuple[str, ...], kind: str) -> DataFrame:
    """blocks, a (of asking), b (of stored) and similarity of the pairs of a block that are alike, by matrix products of tiles.

    asking: blocks, cell, visits, row, id, u; stored: blocks, cell, row, id, u, free. Stored vectors are dealt out over tiles of TILE
    or so; each tile is held by one task, past which the vectors that visit its cell stream, so a task's memory is bounded however
    large a block is. Where most cells are visited anyway, and in blocks that fill no tile, cells are left out.

    kind: `halved`, both are one table, and each two tiles meet once; `asked`, asking rows are part of the table, and meet what
    is `free` in it and one another once; `apart`, two tables. Rows of one id meet in the last only.
    """
    few = asking.filter(F.col("cell") != ODD).agg(F.avg(F.size("visits")), F.max("cell")).first()
    prunes = few[0] is not None and few[0] <= (few[1] + 1) / 4
    n = stored.groupBy(*blocks).agg(F.count("*").alias("n")) if blocks else stored.agg(F.count("*").alias("n"))
    known = lambda rows: rows.join(n, list(blocks)) if blocks else rows.crossJoin(n)
    one = (F.col("n") <= TILE) | F.lit(not prunes)
    stored = known(stored).withColumn("cell", F.when(one, 0).otherwise(F.col("cell"))).drop("n", "visits")
    asking = known(asking).withColumn("visits", F.when(one, F.array(F.lit(0))).otherwise(F.col("visits"))).withColumn("cell", F.when(one, 0).otherwise(F.col("cell"))).drop("n")
    tiles = stored.groupBy(*blocks, "cell").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    place = lambda cell, part: F.col(cell).cast("long") * (1 << 20) + part
    own = F.pmod(F.xxhash64("row"), F.col("tiles"))
    held = stored.join(tiles, [*blocks, "cell"]).withColumn("tile", place("cell", own))
    asks = asking.join(tiles, [*blocks, "cell"]).withColumn("mine", place("cell", own)).drop("tiles") if kind == "halved" else asking
    asks = asks.drop("cell").withColumn("cell", F.explode("visits")).join(tiles, [*blocks, "cell"])
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumn("tile", place("cell", F.col("part")))
    if kind == "halved":  # of two tiles one asks, each as often as it is asked
        asks = asks.filter((F.col("mine") == F.col("tile")) | ((F.col("mine") < F.col("tile")) == ((F.col("mine") + F.col("tile")) % 2 == 0)))
    free = {"halved": lambda: F.col("mine") != F.col("tile"), "asked": lambda: F.lit(False), "apart": lambda: F.lit(True)}[kind]()
    columns = [*blocks, "tile", "side", "row", "free", "id", "u"]
    both = held.withColumn("side", F.lit(0)).select(columns).unionByName(asks.withColumn("side", F.lit(1)).withColumn("free", free).select(columns))
    groups = tiles.agg(F.coalesce(F.sum("tiles"), F.lit(0))).first()[0]
    keys = [*blocks, "tile"]
    dealt = both.repartition(max(1, min(4 * groups, MOST_TASKS)), *keys).sortWithinPartitions(*keys, "side")
    field = {f.name: f for f in both.schema.fields}
    out = T.StructType([*(field[c] for c in blocks), T.StructField("a", field["id"].dataType), T.StructField("b", field["id"].dataType), T.StructField("similarity", T.DoubleType())])

    def run(batches):
        now, parts, tile = None, [], None
        for batch in batches:
            for piece in _runs(batch, [*keys, "side"]):
                key = tuple(piece.column(c)[0].as_py() for c in keys)
                if key != now:
                    now, parts, tile = key, [], None
                if piece.column("side")[0].as_py() == 0:
                    parts.append(piece)
                elif parts:
                    tile = tile or _Tile(parts)
                    for a, b, s in tile.alike(piece, threshold, kind != "apart"):
                        named = [pa.array([x] * len(s), batch.schema.field(c).type) for c, x in zip(blocks, key)]
                        yield pa.RecordBatch.from_arrays([*named, a, b, pa.array(s)], out.names)

    return dealt.mapInArrow(run, out)


def _runs(batch: pa.RecordBatch, keys: list[str]):
    """The batch cut where any of its keys changes."""
    n = len(batch)
    if not n:
        return
    new = np.zeros(n - 1, bool)
    for c in keys:
        x = batch.column(c)
        new |= pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    at = [0, *(np.flatnonzero(new) + 1).tolist(), n]
    for a, z in zip(at, at[1:]):
        yield batch.slice(a, z - a)


def _by_dimension(lengths: np.ndarray, flat: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension the rows that have it, and their vectors."""
    starts, out = np.cumsum(lengths) - lengths, {}
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        out[d] = at, flat[starts[at][:, None] + np.arange(d)]
    return out


class _Tile:
    """Stored vectors of one tile, in a task."""

    def __init__(self, parts: list[pa.RecordBatch]):
        lengths, flats, _ = zip(*map(_columns, parts))
        self.vectors = _by_dimension(np.concatenate(lengths), np.concatenate(flats))
        self.ids = pa.concat_arrays([p.column("id") for p in parts])
        self.row, self.free = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("row", "free"))

    def alike(self, asking: pa.RecordBatch, threshold: float, within: bool):
        """(ids, stored ids, similarities) of alike pairs, a bounded number at a time."""
        ids = asking.column("id")
        row, free = (asking.column(c).to_numpy(zero_copy_only=False) for c in ("row", "free"))
        lengths, flat, _ = _columns(asking)
        for d, (at, u) in _by_dimension(lengths, flat).items():
            if d not in self.vectors:
                continue
            there, v = self.vectors[d]
            for start in range(0, len(at), STRIP):
                i, j = np.nonzero(u[start : start + STRIP] @ v.T >= threshold - SLACK)
                i += start
                for k in range(0, len(i), HITS):
                    x, y = i[k : k + HITS], j[k : k + HITS]
                    s = np.zeros(len(x))
                    for c in range(d):  # in the order of `vectors.dot`, to the last bit
                        s += u[x, c] * v[y, c]
                    p, q = at[x], there[y]
                    ok = (s >= threshold) & (free[p] | self.free[q] | (row[p] < self.row[q]))
                    if within and ok.any():
                        ok &= pc.not_equal(ids.take(pa.array(p)), self.ids.take(pa.array(q))).to_numpy(zero_copy_only=False)
                    if ok.any():
                        yield ids.take(pa.array(p[ok])), self.ids.take(pa.array(q[ok])), s[ok]


def candidates(nodes: DataFrame, threshold: float, blocks: tuple[str, ...], incremental: bool = False, pivots: int = PIVOTS) -> DataFrame:
    """The pairs of nodes (as in `alike`) that all bounds together leave, each once: what an index can rule out of a table."""
    r = radius(threshold)
    rows = units(nodes, [*blocks, "id", *(["is_new"] if incremental else [])])
    chosen_pivots = chosen(rows, pivots)
    everything = placed(rows, chosen_pivots, r)
    stored, everything = everything.drop("visits"), everything.drop("cell")
    if not incremental:
        return met(everything, stored, r, blocks).filter("a < b")
    asking = everything.filter("is_new").drop("is_new")
    return met(asking, stored.withColumnRenamed("is_new", "other"), r, blocks).filter("(other and a < b) or (not other and a <> b)")


class Index:
    """Vectors on disk by cell, below `path`: pivots, and a folder for each cell."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.text(f"{self.path}/about").first()[0]
        known = json.loads(about)
        self.blocks, self.pivots = tuple(known["blocks"]), np.array(known["pivots"], float).reshape(-1, known["dimension"])

    @classmethod
    def create(cls, vectors: DataFrame, path: str, blocks: tuple[str, ...] = (), pivots: int = PIVOTS) -> Index:
        """An index of vectors (id, vector, blocks)."""
        spark = vectors.sparkSession
        found = chosen(units(vectors, []), pivots)
        about = json.dumps({"blocks": list(blocks), "pivots": found.tolist(), "dimension": max(found.shape[1], 1)})
        spark.range(1).select(F.lit(about).alias("value")).write.text(f"{path.rstrip('/')}/about")
        index = cls(spark, path)
        index.add(vectors)
        return index

    def add(self, vectors: DataFrame) -> None:
        """Append vectors, one file a cell: a cell's rows come together first."""
        rows = placed(units(vectors, [*self.blocks, "id"]), self.pivots)
        rows.repartition("cell").write.partitionBy("cell").mode("append").parquet(f"{self.path}/vectors")

    def stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def ranges(self) -> np.ndarray:
        """The least and greatest distance from its pivot in each cell; an empty cell is never visited."""
        found = self.stored().filter(F.col("cell") != ODD).groupBy("cell").agg(F.min("far").alias("least"), F.max("far").alias("most")).collect()
        out = np.tile([np.inf, -np.inf], (len(self.pivots), 1))
        for x in found:
            out[x["cell"]] = x["least"], x["most"]
        return out

    def near(self, vectors: DataFrame, threshold: float) -> DataFrame:
        """Pairs (blocks, id, stored_id, similarity) of vectors given and stored ones that are alike."""
        r = radius(threshold)
        asking = placed(units(vectors, [*self.blocks, "id"]), self.pivots, r, self.ranges())
        asking = asking.withColumn("row", F.lit(0).cast("long"))
        stored = self.stored().withColumn("row", F.xxhash64("id", "u")).withColumn("free", F.lit(True))
        return products(asking, stored, threshold, self.blocks, "apart").select(*self.blocks, F.col("a").alias("id"), F.col("b").alias("stored_id"), "similarity")
