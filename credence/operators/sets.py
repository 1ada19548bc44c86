"""Sets that are alike by Jaccard, exactly, without a join on their members.

Sets of likeness t share a member among the first n - ceil(t n) + 1 of each in one order of all members (the rarest first), and from there
on enough others. A task holds a tile of sets by these first members; sets of like sizes stream past it and meet where they share one. What
sketches don't rule out is compared member by member. A sketch's bits are turned over by members, so where two sketches differ, the sets
differ in as many members at least, and sets of likeness t differ in (1 - t) / (1 + t) of the sum of their sizes at most.

Only whether there is an earlier set is asked. So sets first meet the earliest one of the same least hashes; of those found alike to it
(near copies, as a rule) no two meet again.
"""

from __future__ import annotations

from decimal import Decimal
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from credence.operators.graph import cut
from credence.operators.metric import MOST_TASKS, _runs

#: First members and sets held by a task at most, or so; members read, and meetings and words of sketches looked at, at once.
TILE, TILE_SETS, STRIP, CHUNK = 1 << 22, 1 << 16, 1 << 18, 1 << 19
#: Counts of members are kept by so many hashes. They only order the members.
COUNTED = 1 << 20
#: Rows of a table of numbers that is broadcast, at most.
SMALL = 1 << 20
#: Least hashes of a set: bands, and hashes of a band.
BANDS, WIDTH = 8, 8


def _small(written: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(written) if written.count() <= SMALL else written


def _slices(batch: pa.RecordBatch, column: str):
    """The batch in pieces of STRIP values of a list column or so."""
    ends = np.cumsum(batch.column(column).value_lengths().to_numpy(zero_copy_only=False))
    start = 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, before + STRIP, "right"))), start + (1 << 15), len(batch))
        yield batch.slice(start, stop - start)
        start = stop


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values."""
    return lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)


def _places(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _levels(hashed: DataFrame) -> np.ndarray:
    """For each of COUNTED hashes the level of how often members have it; of constant size. hashed: h."""

    def run(batches):
        total = np.zeros(COUNTED, np.int64)
        for b in batches:
            for x in _slices(b, "h"):
                total += np.bincount(_flat(x.column("h"))[1] & (COUNTED - 1), minlength=COUNTED)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    counts = hashed.select("h").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    levels = np.zeros(COUNTED, np.uint16)
    levels[counts.column("at").to_numpy()] = np.minimum(np.log2(counts.column("n").to_numpy() + 1.0) * 1500, 65535)
    return levels


def _classes(threshold: float) -> np.ndarray:
    """Smallest sizes of classes; sets of different classes that aren't neighbours can't be alike."""
    out, t = [1], Decimal(str(threshold))
    while out[-1] < 1 << 31:
        out.append(max(int(out[-1] / t), out[-1] + out[-1] // 4) + 1)
    return np.array(out)


def _indexed(hashed: DataFrame, threshold: float) -> DataFrame:
    """hashed (its columns and h, the members' hashes) with class, first (the rarest members), sketch and bands in h's place."""
    levels, sizes = _levels(hashed), _classes(threshold)
    kept = [c for c in hashed.columns if c != "h"]
    new = [T.StructField("class", T.LongType()), T.StructField("first", T.ArrayType(T.IntegerType())), T.StructField("sketch", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    schema = T.StructType([*hashed.select(*kept).schema.fields, *new])

    def run(batches):
        for b in batches:
            for x in _slices(b, "h"):
                n, flat = _flat(x.column("h"))
                h, owner = flat.view(np.uint64), np.repeat(np.arange(len(x)), n).astype(np.uint64) << np.uint64(48)
                ordered = np.sort(owner | levels[flat & (COUNTED - 1)].astype(np.uint64) << np.uint64(32) | h >> np.uint64(32))
                taken = n - np.ceil(threshold * n - 1e-6).astype(np.int64) + 1
                first = ordered[_places(n) < np.repeat(taken, n)].astype(np.uint32).view(np.int32)
                kind = np.searchsorted(sizes, n, "right") - 1
                bits = np.maximum(256, 1 << np.ceil(np.log2(2.0 * sizes[kind + 1])).astype(np.int64))
                at = np.cumsum(bits) - bits
                odd = np.bincount(np.repeat(at, n) + (flat & np.repeat(bits - 1, n)), minlength=bits.sum()) & 1
                sketch = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.append(at, bits.sum()).astype(np.int32) // 8), pa.py_buffer(np.packbits(odd.astype(np.uint8)))])
                least = np.sort(owner | (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16))
                cell = (least >> np.uint64(42)).astype(np.int64)  # set and one of its 64 bins
                new = np.append(True, cell[1:] != cell[:-1])
                mins = np.zeros((len(x), BANDS * WIDTH), np.uint64)
                mins[cell[new] >> 6, cell[new] & 63] = least[new] & np.uint64((1 << 48) - 1)
                none, band = (mins.reshape(len(x), BANDS, WIDTH) == 0).all(2), np.tile(np.arange(BANDS, dtype=np.uint64), (len(x), 1))
                for k in range(WIDTH):
                    band = (band ^ mins[:, k::WIDTH]) * np.uint64(0xD6E8FEB86659FD93)
                    band ^= band >> np.uint64(32)
                lists = lambda lengths, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(values))
                band[none] = 0
                columns = [pa.array(kind), lists(taken, first), sketch, lists(np.full(len(x), BANDS), band.view(np.int64).ravel())]
                yield pa.RecordBatch.from_arrays([*(x.column(c) for c in kept), *columns], schema.names)

    return hashed.mapInArrow(run, schema)


def _words(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint64).reshape(len(sketches), -1)


class _Tile:
    """Sets held by a task."""

    def __init__(self, pieces: list[pa.RecordBatch], threshold: float):
        lengths, values = map(np.concatenate, zip(*(_flat(p.column("first")) for p in pieces)))
        self.row, self.n, self.settled = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in pieces]) for c in ("row", "n", "settled"))
        self.sketch = np.concatenate([_words(p.column("sketch")) for p in pieces])
        self.threshold, self.shared, self.sorted = threshold, threshold / (1 + threshold), {}
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        key = (values.view(np.uint32).astype(np.int64) << 31) + self.n[owner]
        order = np.argsort(key)
        self.whole = key[order], owner[order], _places(lengths).astype(np.int32)[order]

    def members(self, smaller: bool, unsettled: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys (member, size) in order, sets and places. smaller: of sets that are smaller than all that ask, for which fewer members do."""
        if (smaller, unsettled) not in self.sorted:
            key, owner, place = self.whole
            keep = np.ones(len(key), bool)
            if smaller:
                keep &= self.n[owner] - place >= 2 * self.shared * self.n[owner] - 1e-6
            if unsettled:
                keep &= ~self.settled[owner]
            self.sorted[smaller, unsettled] = self.whole if keep.all() else (key[keep], owner[keep], place[keep])
        return self.sorted[smaller, unsettled]

    def met(self, asks: pa.RecordBatch, smaller: bool, unsettled: bool, own: bool):
        """Pairs (place in asks, place here) that neither sizes, nor places of a shared member, nor sketches rule out. own: asks are of this tile."""
        row, n = (asks.column(c).to_numpy(zero_copy_only=False) for c in ("row", "n"))
        lengths, values = _flat(asks.column("first"))
        key, owner, place = self.members(smaller, unsettled)
        order = np.argsort(values.view(np.uint32))
        asker = np.repeat(np.arange(len(lengths)), lengths)[order]
        left = n[asker] - _places(lengths)[order]
        at = values.view(np.uint32)[order].astype(np.int64) << 31
        start = np.searchsorted(key, at + np.ceil(self.threshold * n[asker] - 1e-6).astype(np.int64), "left")
        count = np.searchsorted(key, at + np.floor(n[asker] / self.threshold + 1e-6).astype(np.int64), "right") - start
        some = np.flatnonzero(count > 0)
        asker, left, start, count = asker[some], left[some], start[some], count[some]
        ends, found = np.cumsum(count), []
        cuts = np.unique([0, *np.searchsorted(ends, np.arange(CHUNK, ends[-1], CHUNK), "right"), len(ends)]) if len(ends) else []
        for a, z in pairwise(cuts):
            k = count[a:z]
            i = np.repeat(start[a:z], k) + _places(k)
            x, y = np.repeat(asker[a:z], k), owner[i]
            theirs = self.n[y]
            ok = np.minimum(np.repeat(left[a:z], k), theirs - place[i]) >= self.shared * (n[x] + theirs) - 1e-6
            x, y = x[ok], y[ok]
            if own:
                ok = row[x] < self.row[y]
                x, y = x[ok], y[ok]
            found.append(np.unique(x * len(self.row) + y))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        x, y = pairs // len(self.row), pairs % len(self.row)
        mine, width = _words(asks.column("sketch")), self.sketch.shape[1]
        while mine.shape[1] > width:  # of the next class
            mine = mine[:, : mine.shape[1] // 2] ^ mine[:, mine.shape[1] // 2 :]
        share, step = (1 - self.threshold) / (1 + self.threshold), max(1, CHUNK // width)
        few = [np.bitwise_count(mine[x[a : a + step]] ^ self.sketch[y[a : a + step]]).sum(1, dtype=np.int64) <= share * (n[x[a : a + step]] + self.n[y[a : a + step]]) + 1e-3 for a in range(0, len(x), step)]
        ok = np.concatenate(few) if few else np.zeros(0, bool)
        return x[ok], y[ok]


def _met(index: DataFrame, threshold: float) -> DataFrame:
    """i, j: rows of sets of one block that may be alike, each pair once, but of no two settled ones. index: block, class, row, n, first, sketch, settled."""
    tiles = index.groupBy("block", "class").agg(F.sum(F.size("first")).alias("members"), F.count("*").alias("n"))
    tiles = cut(tiles.withColumn("tiles", F.ceil(F.greatest(F.col("members") / TILE, F.col("n") / TILE_SETS))).drop("n"), "tiles")
    tasks = tiles.agg(F.coalesce(F.ceil(F.sum(F.col("members") * F.col("tiles")) / STRIP), F.lit(1))).first()[0]
    tiles = _small(tiles.drop("members"))
    held = index.join(tiles, ["block", "class"]).withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles"))).withColumn("side", F.lit(0))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    same = held.filter("tiles > 1").withColumnRenamed("tile", "mine").withColumn("tile", each).filter((F.col("mine") != F.col("tile")) & ((F.col("mine") < F.col("tile")) == ((F.col("mine") + F.col("tile")) % 2 == 0))).withColumn("side", F.lit(1))
    larger = index.withColumn("class", F.col("class") - 1).join(tiles, ["block", "class"]).withColumn("tile", each).withColumn("side", F.lit(2))
    keys = ["block", "class", "tile"]
    columns = [*keys, "side", "row", "n", "settled", "first", "sketch"]
    both = held.select(columns).unionByName(same.select(columns)).unionByName(larger.select(columns))
    least = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(max(least, min(tasks, MOST_TASKS)), *keys).sortWithinPartitions(*keys, "side", "settled")

    def met(tile, piece, smaller, own):
        for asks in _slices(piece, "first"):
            x, y = tile.met(asks, smaller, piece.column("settled")[0].as_py(), own)
            if len(x):
                yield pa.RecordBatch.from_arrays([asks.column("row").take(pa.array(x)), pa.array(tile.row[y])], ["i", "j"])

    def run(batches):
        now, parts, tile = None, [], None

        def among(parts):
            for p in parts:
                yield from met(tile, p, False, True)

        for batch in batches:
            for piece in _runs(batch, [*keys, "side", "settled"]):
                key, side = tuple(piece.column(c)[0].as_py() for c in keys), piece.column("side")[0].as_py()
                if parts and tile is None and (key != now or side > 0):
                    tile = _Tile(parts, threshold)
                    yield from among(parts)
                if key != now:
                    now, parts, tile = key, [], None
                if side == 0:
                    parts.append(piece)
                elif parts:
                    yield from met(tile, piece, side == 2, False)
        if parts and tile is None:
            tile = _Tile(parts, threshold)
            yield from among(parts)

    return dealt.mapInArrow(run, "i long, j long")


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """block, row, seq of the later of each pair (i, j) that is alike. sets: block, row, seq, t, n."""
    pairs = cut(pairs, "pairs")
    asked = cut(pairs.select(F.col("i").alias("row")).unionByName(pairs.select(F.col("j").alias("row"))).distinct(), "asked")
    few = cut(sets.select("block", "row", "seq", "t", "n").join(_small(asked), "row", "left_semi"), "few")
    side = lambda c, s: few.select(F.col("row").alias(c), *(F.col(x).alias(f"{x}{s}") for x in ("block", "seq", "t", "n")))
    met = pairs.join(side("i", 1), "i").join(side("j", 2), "j").filter("seq1 <> seq2").withColumn("c", F.size(F.array_intersect("t1", "t2")))
    alike = met.filter(F.col("c") >= F.lit(Decimal(str(threshold))) * (F.col("n1") + F.col("n2") - F.col("c")))
    return alike.select(F.col("block1").alias("block"), F.when(F.col("seq1") > F.col("seq2"), F.col("i")).otherwise(F.col("j")).alias("row"), F.greatest("seq1", "seq2").alias("seq"))


def _settled(index: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """block, row, seq of sets that are like the earliest one of a band of theirs."""
    bands = index.select("block", "row", "seq", "n", F.explode("bands").alias("key")).filter("key <> 0")
    least = bands.groupBy("block", "key").agg(F.min_by(F.struct("row", "n"), "seq").alias("least"), F.count("*").alias("of")).filter("of > 1")
    sized = F.least("n", "least.n") >= threshold * F.greatest("n", "least.n") - F.lit(1e-6)
    pairs = bands.drop("seq").join(least.drop("of"), ["block", "key"]).filter((F.col("row") != F.col("least.row")) & sized)
    pairs = pairs.select(F.col("row").alias("i"), F.col("least.row").alias("j")).distinct()
    return _alike(pairs, sets, threshold).distinct()


def like_an_earlier_one(sets: DataFrame, threshold: float) -> DataFrame:
    """block, seq (each once) of sets that are like one of the same block with a smaller seq. sets: block, seq, t (distinct strings). threshold: above 0.

    Equal sets are one set, of the smallest seq; all others of them are like it.
    """
    whole = sets.filter("block is not null and seq is not null").withColumn("t", F.sort_array("t"))
    whole = whole.select("block", "seq", "t", F.size("t").cast("long").alias("n"), F.unhex(F.sha2(F.concat_ws("\x00", "t"), 256)).alias("same"))
    whole = cut(whole.withColumn("row", F.monotonically_increasing_id()), "sets").filter("n > 0")  # not before, where it would make the members twice
    least = whole.groupBy("block", "same").agg(F.min("seq").alias("least"), F.min_by("row", "seq").alias("first"))
    copies = cut(whole.select("block", "same", "seq", "row").join(least, ["block", "same"]).filter("row <> first").select("block", "seq", "row", (F.col("seq") > F.col("least")).alias("later")), "copies")
    index = _indexed(whole.select("block", "row", "seq", "n", F.transform("t", lambda w: F.xxhash64(w)).alias("h")), threshold)
    index = cut(index.join(_small(copies.select("row")), "row", "left_anti"), "index")
    settled = cut(_settled(index, whole, threshold), "settled")
    known = index.drop("bands", "seq").join(_small(settled.select("row").distinct()).withColumn("settled", F.lit(True)), "row", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    later = settled.unionByName(_alike(_met(known, threshold), whole, threshold)).select("block", "seq")
    return later.unionByName(copies.filter("later").select("block", "seq")).distinct()
