"""Periodic runs of words, by suffix trees and branching tandem repeats.

A run is a stretch of consecutive words of smallest period q (words q apart are the same) that is long enough, recurs often
enough and that no neighbouring word extends. Texts are judged one by one, so Spark deals documents out and nothing is
shuffled.

* Where runs can be: all windows of WINDOW words inside a run recur in the text, as a run holds 24 words and three periods
  at least. Stretches covered by recurring windows are cut out; each run lies in one of them, and most texts have none.
* Suffix tree: the suffixes of all stretches of an Arrow batch are ranked by doubling, words of different stretches being
  different letters. Doubling's ranks also give the common prefixes of neighbours, and these the inner nodes: a node is a
  range of ranks, its depth, and the ranges of its children.
* Smaller-half leaf lists: at a node of depth q, for each leaf i in all children but the largest, the leaves i + q and i - q
  are looked up. One that is below the node too, but not below the same child, makes a branching tandem repeat of period q
  at the smaller of the two places. Each leaf is listed O(log n) times.
* Rotation and merging: a branching repeat ends its run, so turning it to the left for as long as the word before is the
  word q later gives the run's start. Repeats of the same ends are one run, of the smallest period.

Nulls and edges: a null, empty or wordless text has no words, no runs and the digest of the empty string; a null id has no
checksum, so its words are never rewritten by `planted`; repeated rows are judged row by row; runs of equal exponent are
told apart by start, then period; an empty table gives an empty result; other columns are not read, whatever their names.
Memory in a task is a few hundred bytes for each word in stretches of one batch, or of one text where that has more.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from credence.llm.common import documents, parallel

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: All windows of this many words in a run recur: LEAST_WORDS >= 2 q + WINDOW - 1 for q <= 8, and 3 q >= that beyond.
WINDOW = 8
#: Words in stretches that are put into one suffix tree, unless one text has more.
BATCH = 1 << 19

Run = tuple[int, int, int]


def ranked(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, ranks, and the common prefix of each suffix with the one before it (0 for the first)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    levels, width, array = [rank.astype(np.int32)], 1, None
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 1) + behind
        array = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[array][1:] != key[array][:-1])))
        rank = np.empty(n, np.int64)
        rank[array] = new
        if new[-1] == n - 1 or width >= n:
            break
        width *= 2
        levels.append(rank.astype(np.int32))
    a, b, common = array[:-1].copy(), array[1:].copy(), np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        fits = np.flatnonzero((a + step <= n) & (b + step <= n))
        same = fits[levels[k][a[fits]] == levels[k][b[fits]]]
        # a suffix shorter than the step has a rank of its own, so equal ranks are equal words
        common[1 + same] += step
        a[same] += step
        b[same] += step
        at_end = (a >= n) | (b >= n)
        a[at_end] = b[at_end] = n
    return array, rank, common


def nodes(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The children of all inner nodes of the suffix tree: first and last rank of the child, of its node, the node's depth.

    A node's largest child is left out.
    """
    n, values = len(common), common.tolist()
    out: list[tuple[int, int, int, int, int]] = []
    # depth, first rank, first rank of the open child, closed children
    stack: list[list] = [[0, 0, 0, []]]

    def close(node: list, last: int) -> None:
        depth, first, child, children = node
        children.append((child, last))
        if depth:
            big = max(range(len(children)), key=lambda i: children[i][1] - children[i][0])
            out.extend((a, z, first, last, depth) for i, (a, z) in enumerate(children) if i != big)

    for i in range(1, n):
        v, first = values[i], i - 1
        while stack[-1][0] > v:
            first = stack[-1][1]
            close(stack.pop(), i - 1)
        if stack[-1][0] == v:
            stack[-1][3].append((stack[-1][2], i - 1))
            stack[-1][2] = i
        else:
            stack.append([v, first, i, [(first, i - 1)]])
    while stack:
        close(stack.pop(), n - 1)
    return tuple(np.array(x, np.int64) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 5


def branching(array: np.ndarray, rank: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all branching tandem repeats."""
    n = len(array)
    starts, periods = [], []
    lo, hi, first, last, depth = nodes(common)
    sizes = hi - lo + 1
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()) + BATCH, BATCH)) if len(sizes) else []
    for x, y in zip(cuts, [*cuts[1:], len(sizes)]):
        if x == y:
            continue
        owner = np.repeat(np.arange(x, y), sizes[x:y])
        within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[x:y]) - sizes[x:y], sizes[x:y])
        leaf, d = array[lo[owner] + within], depth[owner]
        for other, start in ((leaf + d, leaf), (leaf - d, leaf - d)):
            there = (other >= 0) & (other < n)
            r = rank[np.where(there, other, 0)]
            hit = there & (r >= first[owner]) & (r <= last[owner]) & ((r < lo[owner]) | (r > hi[owner]))
            starts.append(start[hit])
            periods.append(d[hit])
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.empty(0, np.int64),) * 2


def merged(text: np.ndarray, starts: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """(start, length, period) rows of the maximal runs that these branching repeats end."""
    out: dict[tuple[int, int], int] = {}
    for q in np.unique(periods):
        places = np.sort(starts[periods == q])
        # the first place of the stretch in which words equal those q later, for each repeat
        differs = np.flatnonzero(text[:-q] != text[q:])
        before = np.searchsorted(differs, places)
        turned = np.where(before > 0, differs[np.maximum(before - 1, 0)] + 1, 0) if len(differs) else np.zeros(len(places), np.int64)
        for s, e in zip(turned.tolist(), (places + 2 * q).tolist()):
            out[s, e] = min(out.get((s, e), q), int(q))
    return np.array(sorted((s, e - s, q) for (s, e), q in out.items()), np.int64).reshape(-1, 3)


def recurring(words: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """The stretches (start, end) covered by windows that recur in the text."""
    n = len(words) - window + 1
    if n < 2:
        return []
    ids = words.astype(np.int64)
    width = 1
    while width < window:  # windows of doubled width get numbers of their own
        pairs = ids[: len(ids) - width] * (len(words) + 1) + ids[width:]
        ids = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return []
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, np.flatnonzero(again), 1)
    np.add.at(change, np.flatnonzero(again) + window, -1)
    inside = np.concatenate(([0], np.cumsum(change) > 0, [0])).astype(np.int8)
    edges = np.flatnonzero(np.diff(inside))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def runs_of(texts: list[np.ndarray]) -> list[list[Run]]:
    """(start, length, period) of the runs of each text, by start, then period. A text is an array of word numbers from 0."""
    out: list[list[Run]] = [[] for _ in texts]
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def search() -> None:
        nonlocal size
        if held:
            offsets = np.cumsum([0] + [len(p) for *_, p in held])
            alphabets = np.cumsum([0] + [int(p.max()) + 1 for *_, p in held])
            whole = np.concatenate([p + a for (*_, p), a in zip(held, alphabets)])
            found = merged(whole, *branching(*ranked(whole)))
            length, period = found[:, 1], found[:, 2]
            found = found[(length >= LEAST_WORDS) & (length >= LEAST_PERIODS * period)]
            for (s, length, period), k in zip(found.tolist(), (np.searchsorted(offsets, found[:, 0], "right") - 1).tolist()):
                i, start, _ = held[k]
                out[i].append((start + s - int(offsets[k]), length, period))
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        for a, z in recurring(text):
            if z - a >= LEAST_WORDS:
                held.append((i, a, text[a:z]))
                size += z - a
        if size >= BATCH:
            search()
    search()
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers in order of first occurrence."""
    first: dict[bytes, int] = {}
    return np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """The places that the words of a text come from: those after a place turn in a circle in every tenth document."""
    places = np.arange(n)
    if doc_id is None or not n:
        return places
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return places
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places[a:] = a + np.arange(n - a) % p
    return places


def dropped(n: int, found: list[Run]) -> np.ndarray:
    """Whether a word lies in a run beyond its first period."""
    change = np.zeros(n + 1, np.int64)
    for s, length, q in found:
        change[s + q] += 1
        change[s + length] -= 1
    return np.cumsum(change[:n]) > 0


def strongest(found: list[Run]) -> Run | None:
    """The run of the greatest exact exponent; ties to the smaller start, then period."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:  # by start and period already
            best = r
    return best


_FIELDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _batches(batches: Iterator[pa.RecordBatch], rewrite: bool) -> Iterator[tuple[pa.Array, list[list[bytes]], list[list[Run]]]]:
    """Ids, words (rewritten if asked) and runs of each part of the input."""
    for b in batches:
        held, ids, size = [], [], 0
        column, texts = b.column("doc_id"), b.column("text").cast(pa.large_binary())
        begun = 0
        for i, t in enumerate(texts):
            words = (t.as_py() or b"").split()
            numbers = numbered(words)
            if rewrite and words:
                places = planted(column[i].as_py(), len(words))
                numbers = numbers[places]
                if places[-1] != len(words) - 1:
                    words = [words[k] for k in places.tolist()]
            held.append(words)
            ids.append(numbers)
            size += len(words)
            if size >= 2 * BATCH or i == len(texts) - 1:
                yield column.slice(begun, i + 1 - begun), held, runs_of(ids)
                held, ids, size, begun = [], [], 0, i + 1


def find(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period in words) of each text as it is."""

    def run(batches):
        for ids, _, found in _batches(batches, False):
            rows = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
            yield pa.RecordBatch.from_arrays([ids, rows], ["doc_id", "runs"])

    return parallel(documents(docs)).mapInArrow(run, "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>")


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, text: the words left when each run keeps its first period, joined by one space; a null text stays null."""

    def run(batches):
        for b in batches:
            for ids, words, found in _batches([b], False):
                kept = [b" ".join([w for w, gone in zip(x, dropped(len(x), r).tolist()) if not gone]).decode() for x, r in zip(words, found)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.string())], ["doc_id", "text"])

    rows = documents(docs)
    return parallel(rows.filter("text is not null")).mapInArrow(run, "doc_id long, text string").unionByName(rows.filter("text is null"))


def digests(docs: DataFrame) -> DataFrame:
    """Runs of texts of which every tenth is made periodic from some word on: their number, the strongest, digests."""

    def run(batches):
        for ids, words, found in _batches(batches, True):
            columns: list[list] = [[] for _ in range(7)]
            for x, r in zip(words, found):
                best = strongest(r)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in r)
                kept = [w for w, gone in zip(x, dropped(len(x), r).tolist()) if not gone] if r else x
                values = (len(r), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())
                for c, v in zip(columns, values):
                    c.append(v)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], [f.split()[0] for f in _FIELDS.split(", ")])

    return parallel(documents(docs)).mapInArrow(run, _FIELDS)


ORACLE_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295::UBIGINT, list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
      lambda c, b: list_reduce(
        list_prepend(xor(c, b), list_transform(range(8), lambda k: CAST(k AS UBIGINT))),
        lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END))) AS h
  FROM documents
), a AS (
  SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n, h % 10 = 0 AND len(w) > 0 AS turned, CAST(h // 10 AS BIGINT) AS g FROM t
), p AS (
  SELECT *, CASE WHEN turned THEN g % n ELSE n END AS a, CASE WHEN turned THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM a
), x AS MATERIALIZED (
  SELECT r, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)
), e AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM x JOIN x y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), s AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e
), m AS (
  SELECT r, q, min(i) AS s, count(*) + q AS l FROM s GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), u AS MATERIALIZED (
  SELECT r, s, l, min(q) AS q FROM m GROUP BY r, s, l
), b AS (
  SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY l / q DESC, s, q) = 1
), c AS (
  SELECT r, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM u GROUP BY r
), k AS (
  SELECT x.r, string_agg(word, ' ' ORDER BY i) AS kept FROM x
  WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.r = x.r AND x.i >= u.s + u.q AND x.i < u.s + u.l) GROUP BY x.r
)
SELECT t.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period,
  CAST(1000 * b.l // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b ON b.r = t.r LEFT JOIN c ON c.r = t.r LEFT JOIN k ON k.r = t.r
"""
