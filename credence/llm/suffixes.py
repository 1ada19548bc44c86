"""Substring deduplication by sparse suffix arrays, sorted deep and shallow.

A byte goes if a string of SPAN bytes covers it that also starts in a document of a smaller id. A text of n bytes has n - SPAN + 1
such windows. They are compared through anchors: the anchor of a window is the one of its ANCHOR-byte strings with the
smallest hash (the first of equals), so equal windows have equal anchors at equal places. Some 20 windows in a row share an anchor; a
stretch (an anchor with the windows that it owns, 69 bytes on the average) is what is sorted and what travels: a 20th of all suffixes.

* Sorting (`deep_shallow`): the suffixes from the anchors on, up to the end of their stretches, and the texts before them, read
  backwards, are sorted by multikey quicksort, eight bytes a character, down to SHALLOW bytes. Groups that agree that far
  are ordered by blind tries: a node is the depth at which its suffixes part, and they are dealt out by their byte there. What lies
  between is passed over by comparing with the group's first suffix alone. Common prefixes of neighbours come with it.
* Windows: two of place o in their stretches are equal if the suffixes agree for SPAN - o bytes and what is before them
  for o bytes. Both are ranges of the two orders, so equal windows are equal pairs of range numbers; of these the smallest document
  keeps its window. Two windows of a stretch overlap, so what goes of a stretch is one span.
* Spreading: stretches go to buckets by a hash of the anchor, packed and compressed by bucket. There are as many buckets as the input
  needs for BUCKET bytes each.
* Before they go: each task runs the same search over its own chunks of CHUNK bytes. Windows that a smaller document of the chunk
  has are decided there, and don't travel; a passage in a third of all documents travels once a chunk.
* Buckets that still have more than LIMIT bytes (an anchor that is frequent in ever different surroundings) are searched in pieces
  of that size; what is left of a piece goes on as single windows to buckets by a hash of all SPAN bytes, and is searched once more there.

Every step compares bytes; hashes only say where stretches meet. Nothing is capped or sampled.

Nulls and edges: a null text is empty; a text under SPAN bytes has no windows and stays whole; matches never cross documents; a row
with a null id keeps all its bytes and takes none from others; rows of one id take nothing from one another: each loses what
documents of smaller ids have; of a smaller id any of its rows' texts counts; an empty table gives an empty result. Other columns
pass only through `clean`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from credence.llm.common import materialise, parallel

SPAN, ANCHOR, SHALLOW = 50, 12, 24
#: Bytes of text searched at a time where it is read, and bytes of stretches that a bucket should have and may have.
CHUNK, BUCKET, LIMIT = 1 << 23, 1 << 23, 1 << 25
#: Bytes of stretches for a byte of text: a stretch has SPAN - 1 bytes more than windows, and owns (SPAN - ANCHOR + 2) / 2.
GROWTH = 1 + (SPAN - 1) / ((SPAN - ANCHOR + 2) / 2)
_PAD = 16
_SLICE = 1 << 20
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
#: The first 0 to 8 bytes of a big-endian word.
_FIRST = np.array([0] + [(2**64 - 1) ^ (2 ** (64 - 8 * k) - 1) for k in range(1, 9)], np.uint64)
#: Words below 256 ** k have 8 - k leading zero bytes at least.
_POWERS = np.array([256**k for k in range(8)], np.uint64)


def padded(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([*parts, bytes(_PAD)]), np.uint8)


def _view(buf: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from each byte on as a word."""
    return np.ndarray((len(buf) - 7,), kind, buf, 0, (1,))


def _characters(view: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth) -> np.ndarray:
    """The bytes depth to depth + 8 of each string as one character; zeros beyond its end."""
    at = np.minimum(starts + depth, len(view) - 1)
    return view[at].astype(np.uint64) & _FIRST[np.clip(lengths - depth, 0, 8)]


def _equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes of two words are the same."""
    return 8 - np.searchsorted(_POWERS, a ^ b, "right")


def deep_shallow(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings of a padded buffer, and each one's common prefix with the one before it (0 for the first)."""
    n, view = len(starts), _view(buf, ">u8")
    common = np.zeros(n, np.int64)
    if not n:
        return np.empty(0, np.int64), common
    order = np.arange(n)
    # multikey quicksort: places that share all characters so far are a group; groups are sorted by their next one
    places, group = np.arange(n), np.zeros(n, np.int64)
    for depth in range(0, shallow, 8):
        members = order[places]
        key = _characters(view, starts[members], lengths[members], depth)
        by = np.lexsort((key, group)) if depth else np.argsort(key)
        order[places], key = members[by], key[by]
        inner = group[1:] == group[:-1]
        parted = np.flatnonzero(inner & (key[1:] != key[:-1])) + 1
        common[places[parted]] = depth + _equal_bytes(key[parted], key[parted - 1])
        places, group = _open(places, np.cumsum(np.concatenate(([True], ~inner | (key[1:] != key[:-1])))))
        if not len(places):
            break
    _blind_tries(buf, view, starts, lengths, order, common, places, group, shallow)
    common[1:] = np.minimum(common[1:], np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    return order, common


def _open(places: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without groups of one; groups are numbered in order."""
    edge = np.concatenate(([True], group[1:] != group[:-1], [True]))
    more = ~(edge[:-1] & edge[1:])
    return places[more], group[more]


def _blind_tries(buf, view, starts, lengths, order, common, places, group, shallow: int) -> None:
    """Order the groups of strings that agree on their first bytes, all tries one level at a time."""
    depth = np.minimum(lengths[order[places]], shallow)
    while len(places):
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(heads, len(group)))
        members = order[places]
        base = np.repeat(np.minimum.reduceat(depth, heads), sizes)
        leader = np.repeat(members[heads], sizes)
        shared = np.minimum(lengths[members], lengths[leader])
        undecided, k = np.flatnonzero(shared > base), 0
        while len(undecided):
            m, f, at = members[undecided], leader[undecided], base[undecided] + 8 * k
            same = _equal_bytes(_characters(view, starts[m], lengths[m], at), _characters(view, starts[f], lengths[f], at))
            stop = same < 8
            shared[undecided[stop]] = np.minimum(shared[undecided[stop]], at[stop] + same[stop])
            undecided, k = undecided[~stop & (at + 8 < shared[undecided])], k + 1
        parting = np.repeat(np.minimum.reduceat(shared, heads), sizes)
        byte = np.where(lengths[members] > parting, buf[np.minimum(starts[members] + parting, len(buf) - 1)].astype(np.int64), -1)
        by = np.lexsort((byte, group))
        order[places], byte = members[by], byte[by]
        inner = np.concatenate(([False], group[1:] == group[:-1]))
        new = np.concatenate(([True], byte[1:] != byte[:-1]))
        common[places[inner & (new | (byte < 0))]] = parting[inner & (new | (byte < 0))]
        group, on = np.cumsum(~inner | new), byte >= 0
        depth = parting[on] + 1
        left, kept = places[on], group[on]
        edge = np.concatenate(([True], kept[1:] != kept[:-1], [True])) if len(kept) else np.array([True])
        more = ~(edge[:-1] & edge[1:])
        places, group, depth = left[more], kept[more], depth[more]


def _mixed(view: np.ndarray, at) -> np.ndarray:
    """A 64-bit hash of the ANCHOR bytes from each place on."""
    key = view[at] * _A
    key ^= key >> _U(32)
    key += view[at + ANCHOR - 8] * _B
    key ^= key >> _U(29)
    key *= _C
    return key


def search(buf: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches with anchors `at` that own the windows starting `low` to `high` bytes before: the least and greatest of the
    windows that a smaller document has (-1 if none), and of those that none has."""
    n = len(at)
    first, last = np.full(n, SPAN, np.int64), np.full(n, -1, np.int64)
    rest_first, rest_last = low.copy(), high.copy()
    # anchors of one document need no sorting
    mixed = _mixed(_view(buf, "<u8"), at)
    by = np.argsort(mixed)
    heads = np.flatnonzero(np.concatenate(([True], mixed[by][1:] != mixed[by][:-1]))) if n else np.empty(0, np.int64)
    if n:
        several = np.minimum.reduceat(doc[by], heads) < np.maximum.reduceat(doc[by], heads)
        by = by[np.repeat(several, np.diff(np.append(heads, n)))]
    if not n or not len(by):
        return np.full(n, -1, np.int64), last, rest_first, rest_last
    order, after = deep_shallow(buf, at[by], SPAN - low[by])
    mine = by[order]
    backwards = np.concatenate((buf[: len(buf) - _PAD][::-1], np.zeros(_PAD, np.uint8)))
    other, before = deep_shallow(backwards, len(buf) - _PAD - at[mine], high[mine])
    lo, hi, ids = low[mine], high[mine], doc[mine]
    left = np.empty(len(mine), np.int64)
    open_first, open_last = np.full(len(mine), SPAN, np.int64), np.full(len(mine), -1, np.int64)
    for o in range(SPAN - ANCHOR + 1):
        owners = np.flatnonzero((lo <= o) & (hi >= o))
        if not len(owners):
            continue
        right = np.cumsum(after < SPAN - o)
        left[other] = np.cumsum(before < o)
        key = right[owners] * (len(mine) + 1) + left[owners]
        by_key = np.argsort(key)
        key = key[by_key]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        theirs = ids[owners[by_key]]
        least = np.repeat(np.minimum.reduceat(theirs, heads), np.diff(np.append(heads, len(key))))
        gone, stays = owners[by_key[theirs > least]], owners[by_key[theirs <= least]]
        first[mine[gone]] = np.minimum(first[mine[gone]], o)
        last[mine[gone]] = o
        open_first[stays] = np.minimum(open_first[stays], o)
        open_last[stays] = o
    rest_first[mine], rest_last[mine] = open_first, open_last
    first[last < 0] = -1
    return first, last, rest_first, rest_last


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts between starts and ends: the place of each stretch's anchor, its first window's and its last window's."""
    n = len(buf) - _PAD
    owner = np.full(max(n, 0), -1, np.int32)
    view = _view(buf, "<u8")
    for base in range(0, n - SPAN + 1, _SLICE):
        size = min(_SLICE, n - SPAN + 1 - base)
        reach = size + SPAN - ANCHOR
        key = view[base : base + reach] * _A
        key ^= key >> _U(32)
        key += view[base + ANCHOR - 8 : base + ANCHOR - 8 + reach] * _B
        key ^= key >> _U(29)
        key *= _C
        key &= _U(0xFFFFFFFF00000000)
        key |= np.arange(reach, dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN - ANCHOR + 1:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        over = SPAN - ANCHOR + 1 - width
        key = np.minimum(key[:-over], key[over:]) if over else key
        owner[base : base + size] = (key & _U(0xFFFFFFFF)).astype(np.int64) + base
    for a, z in zip(np.maximum(starts, ends - SPAN + 1).tolist(), ends.tolist()):
        owner[a:z] = -1
    if not n:
        return (np.empty(0, np.int64),) * 3
    heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    tails = np.append(heads[1:], n) - 1
    real = owner[heads] >= 0
    heads, tails = heads[real], tails[real]
    return owner[heads].astype(np.int64), heads, tails


def packed(raw: bytes, doc, place, anchor, first, last) -> bytes:
    """Stretches as one compressed block: ids, places in texts, anchors behind the first window, numbers of windows, bytes."""
    text = b"".join([raw[a:z] for a, z in zip(first.tolist(), (last + SPAN).tolist())])
    head = [np.array([len(doc)]), _steps(doc), _steps(place), (anchor - first).astype(np.uint8), (last - first + 1).astype(np.uint8)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*(x.tobytes() for x in head), text]))


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of 64-bit numbers, first bytes first: small ones leave zeros that compress to nothing."""
    return np.diff(x, prepend=0).view(np.uint8).reshape(-1, 8).T


def _summed(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T.copy().view(np.int64)[:, 0])


def unpacked(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer of some blocks' bytes, and their stretches: ids, places in texts, anchors, first and last windows in the buffer."""
    docs, places, befores, counts, texts = [], [], [], [], []
    for block in blocks:
        raw = zstandard.ZstdDecompressor().decompress(block)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        docs.append(_summed(raw, n, 8))
        places.append(_summed(raw, n, 8 + 8 * n))
        befores.append(np.frombuffer(raw, np.uint8, n, 8 + 16 * n))
        counts.append(np.frombuffer(raw, np.uint8, n, 8 + 17 * n))
        texts.append(raw[8 + 18 * n :])
    count = np.concatenate(counts).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(count + SPAN - 1)[:-1])).astype(np.int64)
    return padded(texts), np.concatenate(docs), np.concatenate(places), first + np.concatenate(befores), first, first + count - 1


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Rows of removed spans, those that touch joined."""
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1]))) if len(doc) else np.empty(0, bool)
    heads = np.flatnonzero(new)
    ends = np.maximum.reduceat(end, heads) if len(heads) else end
    return _rows(None, None, doc[heads], start[heads], ends)


def _rows(bucket, data, doc, start, end) -> pa.RecordBatch:
    """A batch of spans or, if `data` is given, of blocks."""
    n = len(data) if data is not None else len(doc)
    columns = [(bucket, pa.int64()), (data, pa.binary()), (doc, pa.int64()), (start, pa.int64()), (end, pa.int64())]
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in columns], ["bucket", "data", "doc_id", "start", "end"])


_SCHEMA = "bucket long, data binary, doc_id long, start long, end long"


def _blocks(buf: np.ndarray, bucket: np.ndarray, doc, place, anchor, first, last) -> pa.RecordBatch:
    """Stretches by bucket. `place` is the first window's place in its text."""
    raw = buf.tobytes()
    by = np.argsort(bucket, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], bucket[by][1:] != bucket[by][:-1])))
    parts = [by[a:z] for a, z in zip(heads, np.append(heads[1:], len(by)))]
    return _rows(bucket[by[heads]], [packed(raw, doc[p], place[p], anchor[p], first[p], last[p]) for p in parts], None, None, None)


def _chunk(texts: list[bytes], doc: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The spans that a chunk's own documents decide, and its stretches that have to meet others."""
    buf = padded(texts)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate(([0], ends[:-1]))
    at, head, tail = anchors(buf, starts, ends)
    if not len(at):
        return
    k = np.searchsorted(ends, at, "right")
    found, last, low, high = search(buf, at, at - tail, at - head, doc[k])
    shift = place[k] - starts[k]
    gone = last >= 0
    yield _spans(doc[k][gone], (at - last + shift)[gone], (at - found + SPAN + shift)[gone])
    on = np.flatnonzero(high >= 0)
    if len(on):
        key = _mixed(_view(buf, "<u8"), at[on])
        key = (key ^ (key >> _U(31))) * _B  # anchors have small hashes, so these are mixed once more
        first, final = (at - high)[on], (at - low)[on]
        yield _blocks(buf, ((key >> _U(16)) % _U(buckets)).astype(np.int64), doc[k][on], (first + shift[on]), at[on], first, final)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, int]]:
    """text, id, place of the texts; long ones in pieces that share SPAN - 1 bytes. Rows of an id that has several differ in `slot`."""
    for b in batches:
        for d, slot, t in zip(b.column("doc_id").to_pylist(), b.column("slot").to_pylist(), b.column("text").cast(pa.large_binary())):
            text = t.as_py()
            for a in range(0, max(len(text) - SPAN + 1, 0), CHUNK):
                yield text[a : a + CHUNK + SPAN - 1], d, (slot << 32) + a


def _read(rows: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        texts, ids, places, size = [], [], [], 0
        for t, d, p in _pieces(batches):
            if size and size + len(t) > CHUNK:
                yield from _chunk(texts, np.array(ids, np.int64), np.array(places, np.int64), buckets)
                texts, ids, places, size = [], [], [], 0
            texts.append(t)
            ids.append(d)
            places.append(p)
            size += len(t)
        if texts:
            yield from _chunk(texts, np.array(ids, np.int64), np.array(places, np.int64), buckets)

    return rows.mapInArrow(run, _SCHEMA).withColumn("bucket", F.coalesce("bucket", F.pmod("doc_id", F.lit(buckets))))


def _meet(rows: DataFrame, buckets: int, limit: int) -> DataFrame:
    """Spans found among the stretches of each bucket; spans that come in go out. Past `limit` bytes: single windows for another round."""

    def found(blocks: list[bytes], whole: bool) -> Iterator[pa.RecordBatch]:
        buf, doc, place, at, head, tail = unpacked(blocks)
        first, last, low, high = search(buf, at, at - tail, at - head, doc)
        shift, gone = place - head, last >= 0
        yield _spans(doc[gone], (at - last + shift)[gone], (at - first + SPAN + shift)[gone])
        if not whole:
            on = np.flatnonzero(high >= 0)
            n = (high - low + 1)[on]
            each = np.repeat(on, n)
            window = np.repeat((at - high)[on], n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            view, key = _view(buf, "<u8"), np.zeros(len(each), np.uint64)
            for x in [*range(0, SPAN - 8, 8), SPAN - 8]:
                key = (key ^ view[window + x]) * _A
                key ^= key >> _U(29)
            if len(each):
                yield _blocks(buf, ((key >> _U(16)) % _U(buckets)).astype(np.int64), doc[each], window + shift[each], at[each], window, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, whole = [], 0, True
        for b in batches:
            spans = b.filter(pa.compute.is_null(b.column("data")))
            if spans.num_rows:
                yield _rows(None, None, *(spans.column(c) for c in ("doc_id", "start", "end")))
            for x in b.column("data").drop_null():
                block = x.as_py()
                n = zstandard.frame_content_size(block)
                if held and size + n > limit:
                    whole = False
                    yield from found(held, whole)
                    held, size = [], 0
                held.append(block)
                size += n
        if held:
            yield from found(held, whole)

    return rows.groupBy("bucket").applyInArrow(run, _SCHEMA)


def _slots(docs: DataFrame) -> DataFrame:
    """doc_id, slot, text of the rows with an id and a text. Texts of one id are told apart by slots, if any id has several."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and octet_length(text) >= 1")
    digests = rows.select("doc_id", F.xxhash64("text").alias("digest"))
    several = digests.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    several = materialise(several, "repeated-ids")
    if several.isEmpty():
        return rows.withColumn("slot", F.lit(0).cast("long"))
    found = digests.join(several, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("digest")).alias("digests"))
    rows = rows.join(found, "doc_id", "left").withColumn("slot", F.coalesce(F.array_position("digests", F.xxhash64("text")) - 1, F.lit(0)).cast("long"))
    return rows.select("doc_id", "slot", "text")


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, slot, spans: the byte spans of each text that go; they may touch and overlap. What is gathered is one text's."""
    return _removed(_slots(docs))


def _removed(rows: DataFrame) -> DataFrame:
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size * GROWTH / BUCKET) + 1
    found = materialise(_meet(_read(parallel(rows), buckets), buckets, LIMIT), "removed")
    again = found.filter("data is not null")
    spans = found.filter("data is null")
    if not again.isEmpty():
        spans = spans.unionByName(_meet(again, buckets, 1 << 62))
    slot = F.shiftright("start", 32)
    base = F.shiftleft(slot, 32)
    span = F.struct((F.col("start") - base).alias("start"), (F.col("end") - base).alias("end"))
    return spans.groupBy("doc_id", slot.alias("slot")).agg(F.collect_list(span).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs."""
    out: list[tuple[int, int]] = []
    for a, z in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2]))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left, for each row of docs."""
    rows = _slots(docs)
    none = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("slot"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = none.filter("doc_id is null or octet_length(text) = 0")
    joined = rows.join(_removed(rows), ["doc_id", "slot"], "left").select("doc_id", "text", "spans")
    joined = joined.unionByName(none.select("doc_id", "text", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans")))

    def run(batches):
        for b in batches:
            columns: list[list] = [[] for _ in range(4)]
            for t, s in zip(b.column("text").cast(pa.large_binary()), b.column("spans")):
                text, spans = t.as_py(), merged(s.as_py())
                values = len(text), sum(z - a for a, z in spans), len(spans), hashlib.sha256(_without(text, spans)).hexdigest()
                for c, v in zip(columns, values):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame) -> DataFrame:
    """docs without the repeated bytes, `text` as UTF-8 in which a cut character leaves nothing; all other columns as they are."""
    key = docs.withColumn("__s_text", F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)))
    rows = _slots(docs)
    spans = rows.withColumn("__s_text", F.xxhash64("text")).select("doc_id", "slot", "__s_text").distinct().join(_removed(rows), ["doc_id", "slot"])
    spans = spans.select(F.col("doc_id").alias("__s_id"), F.col("__s_text").alias("__s_digest"), F.col("spans").alias("__s_spans"))
    joined = key.join(spans, (F.col("doc_id").cast("long") == F.col("__s_id")) & (F.col("__s_text") == F.col("__s_digest")), "left").drop("__s_id", "__s_text", "__s_digest")
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            new = []
            for t, s in zip(b.column(at), b.column(b.num_columns - 1)):
                text, found = t.as_py(), s.as_py()
                new.append(_without(text.encode(), merged(found)).decode(errors="ignore") if found else text)
            columns = list(b.columns[:-1])
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents
), c AS (
  SELECT r, doc_id, regexp_extract_all(x, '.{1,100}') AS c, CAST(length(x) / 2 AS BIGINT) AS n FROM d WHERE doc_id IS NOT NULL
), k AS (
  SELECT r, doc_id, n, k, c[k + 1] || coalesce(c[k + 2], '') AS s FROM (SELECT *, unnest(range(len(c))) AS k FROM c)
), w AS MATERIALIZED (
  SELECT r, doc_id, p, substr(s, 2 * (p - 50 * k) + 1, 100) AS g FROM (SELECT *, unnest(range(50 * k, least(50 * k + 50, n - 49))) AS p FROM k WHERE n >= 50)
), f AS (
  SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)
), m AS (
  SELECT r, p, p - lag(p, 1, -1000) OVER (PARTITION BY r ORDER BY p) > 50 AS new FROM w JOIN f USING (g) WHERE doc_id > first
), i AS (
  SELECT r, p, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS island FROM m
), s AS (
  SELECT r, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY r, island
), g AS (
  SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM (SELECT r, a, z FROM s UNION ALL SELECT r, strlen(t), strlen(t) FROM d)
), j AS (
  SELECT g.r, sum(z - a) AS removed, count(*) - 1 AS spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, z) AS kept FROM g JOIN d ON d.r = g.r GROUP BY g.r
)
SELECT doc_id, CAST(strlen(t) AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN j ON j.r = d.r
"""
