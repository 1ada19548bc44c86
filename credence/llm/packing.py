"""Best-fit packing by minimum bin slack.

One Arrow pass tokenises whole texts, cuts what is longer than a sequence into pieces and keeps their lengths and
checksums. Packing needs only how many pieces there are of each length (at most `capacity` numbers, whatever the input):
for a bin, begun by the longest length left, a subset-sum dynamic programme over the available lengths - a bitset, an
integer whose bit s says that s tokens can be reached - finds the fullest feasible combination. That combination is
removed as often as it is available, so each step uses up a length and there are at most a few thousand patterns.
Pieces then find their places by rank among those of their length; the ranks of a hot length, which may be that of a
third of all pieces, are dealt out over as many tasks as it makes shares HOT of all pieces.

Nulls and edges: a null text is empty, and an empty document is its end token alone; repeated rows are documents each;
an empty table gives an empty result. Sequence numbers are dense from 0.
"""

from __future__ import annotations

import re
import zlib
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from credence.llm import common
from credence.llm.common import documents, inline, materialise, parallel

CAPACITY, END = 4096, 1
#: Words held by a worker between tasks; later ones are encoded where they occur.
CACHE = 150_000
CHUNK = 1 << 20

# -- tokenising ------------------------------------------------------------------------------------------------------

#: Cuts lower-case Latin-1 text as the tokenizer's own pattern does; other texts go to the tokenizer whole.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\x09-\\x0d\\x20\\x85\\xa0a-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")
_BEYOND = re.compile("[^\x00-\xff]")


#: How a byte-level vocabulary writes bytes: those that print as themselves, the others as letters from U+0100 on.
_PRINTING = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTING)}


class Encoder:
    """ids of texts as little-endian 32-bit bytes, by a public tokenizer and a bounded cache of its words.

    The tokenizer cuts a text by its pattern and encodes each cut by itself, so a text's ids are those of its cuts in a
    row. `safe` tells texts for which the cuts are known here (Latin-1 without the special tokens' opening mark).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model

    def _cut(self, word: str) -> bytes:
        """ids of one cut, by the tokenizer's own model: what it does with a cut, without what it notes besides."""
        plain = word if word.isascii() and word.isalnum() else word.encode("utf-8").decode("latin-1").translate(_BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(plain)]
        return pack_ids(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        held, size = [], 0
        for i, t in enumerate(texts):
            if _BEYOND.search(t) or "<|" in t:
                out[i] = self.whole(t)
            else:
                held.append(i)
                size += len(t)
                if size >= CHUNK:
                    self._chunk(texts, held, out)
                    held, size = [], 0
        self._chunk(texts, held, out)
        return out

    def _chunk(self, texts: list[str], which: list[int], out: list) -> None:
        if not which:
            return
        cut = [_PIECES.findall(texts[i].lower()) for i in which]
        cache = self.cache
        new = list(set().union(*cut).difference(cache))
        known = cache
        if new:
            ids = [self._cut(w) for w in new]
            if len(cache) + len(new) <= CACHE:
                cache.update(zip(new, ids))
            else:
                known = _Two(cache, dict(zip(new, ids)))
        for i, words in zip(which, cut):
            out[i] = b"".join(map(known.__getitem__, words))


class _Two(dict):
    def __init__(self, first: dict, second: dict):
        super().__init__(second)
        self.first = first

    def __missing__(self, word: str) -> bytes:
        return self.first[word]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and path; it lives on between tasks."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    path = path or tokenizer_path()

    def run(batches):
        enc, end = encoder(path), np.array([END], "<u4").tobytes()
        for b in batches:
            ids, ends = b.column("doc_id").to_pylist(), b.column("text")
            for a in range(0, len(ids), 500):
                texts = [x.as_py() or "" for x in ends.slice(a, 500)]
                rows, held = [], []
                for d, raw in zip(ids[a : a + 500], enc.encode(texts)):
                    raw += end
                    n = len(raw) // 4
                    for k, s in enumerate(range(0, n, capacity)):
                        part = raw[4 * s : 4 * min(n, s + capacity)]
                        rows.append((d, k, s, len(part) // 4, zlib.crc32(part)))
                        if with_ids:
                            held.append(np.frombuffer(part, "<u4").astype(np.int32))
                c = list(zip(*rows)) if rows else [[]] * 5
                columns = [pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(held, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return parallel(documents(docs)).mapInArrow(run, _PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


# -- packing ---------------------------------------------------------------------------------------------------------


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths, longest first, of the fullest combination of available ones within `room`; among equals, long ones first.

    Bounded subset sums by bitsets: a length available m times enters as m = 1 + 2 + 4 + ... copies.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for x in lengths:
        if x > room:
            continue
        m, part = min(counts[x], room // x), 1
        while m > 0:
            take = min(part, m)
            if take * x <= room:
                steps.append((x, take, reach))
                reach |= (reach << (take * x)) & mask
            m -= take
            part *= 2
        if reach >> room & 1:
            break
    s, out = reach.bit_length() - 1, []
    for x, take, before in reversed(steps):
        if not before >> s & 1:
            out += [x] * take
            s -= take * x
    return sorted(out, reverse=True)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins), all pieces placed."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    out = []
    while counts:
        lengths = sorted(counts, reverse=True)
        first = lengths[0]
        counts[first] -= 1
        rest = fullest([x for x in lengths if counts[x]], counts, capacity - first)
        counts[first] += 1
        bin_, need = [first, *rest], {}
        for x in bin_:
            need[x] = need.get(x, 0) + 1
        times = min(counts[x] // m for x, m in need.items())
        out.append((bin_, times))
        for x, m in need.items():
            counts[x] -= m * times
            if not counts[x]:
                del counts[x]
    return out


def _places(bins: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length its rows (first rank, pieces a bin, first sequence, first offset), by rank."""
    used, table, sequence = {}, {}, 0
    for lengths, times in bins:
        offset, first = 0, {}
        for x in lengths:
            first.setdefault(x, [offset, 0])[1] += 1
            offset += x
        for x, (o, m) in first.items():
            table.setdefault(x, []).append((used.get(x, 0), m, sequence, o))
            used[x] = used.get(x, 0) + m * times
        sequence += times
    return {x: np.array(rows, np.int64) for x, rows in table.items()}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset; gapless from 0 in each sequence."""
    cut = materialise(pieces(docs, path, capacity, with_ids), "pieces")
    spark = cut.sparkSession
    # At most `capacity` rows of two numbers: bounded whatever the input.
    totals = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    many = int(common.HOT * sum(totals.values())) + 1
    parts = [(x, -(-n // many)) for x, n in sorted(totals.items()) if n > many]  # 1 / HOT lengths at most, and twice as many parts
    hot = F.broadcast(inline(spark, parts, "hot_length long, parts long"))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce("parts", F.lit(1)))
    cut = cut.join(hot, F.col("length") == F.col("hot_length"), "left").withColumn("salt", salt.cast("long"))
    known = cut.filter("hot_length is not null").groupBy("length", "salt").agg(F.count("*").alias("n")).collect() if parts else []
    cut = cut.drop("hot_length", "parts")
    first: dict[tuple[int, int], int] = {}
    before: dict[int, int] = {}
    for x, s, n in sorted((r["length"], r["salt"], r["n"]) for r in known):
        first[x, s] = before.get(x, 0)
        before[x] = before.get(x, 0) + n
    table = _places(patterns(totals, capacity))
    sent = spark.sparkContext.broadcast((first, table))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rn", F.row_number().over(order))

    def run(batches):
        first, table = sent.value
        for b in batches:
            length, salt, rn = (b.column(c).to_numpy() for c in ("length", "salt", "rn"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                rank = np.array([first.get((int(x), int(s)), 0) for s in salt[at]], np.int64) + rn[at] - 1
                rows = table[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
                k = rank - row[:, 0]
                sequence[at] = row[:, 2] + k // row[:, 1]
                offset[at] = row[:, 3] + k % row[:, 1] * x
            keep = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return ranked.mapInArrow(run, _PIECE_SCHEMA + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long")
