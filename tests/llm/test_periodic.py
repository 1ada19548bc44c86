import hashlib
import zlib

import numpy as np
import pytest

from credence.llm import periodic as P
from tests.llm.fixtures import awkward, empty

SCHEMA = "doc_id long, text string"


def brute(words):
    """All maximal repetitions, each period tried at each place."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(kept))


def texts(n=400):
    rng = np.random.default_rng(3)
    for k in range(n):
        x = rng.integers(0, rng.integers(1, 6), rng.integers(0, 130)).tolist()
        if k % 3 == 0 and len(x) > 30:
            p, a = int(rng.integers(1, len(x) // 3)), int(rng.integers(0, len(x) - 3))
            x[a:] = [x[a + i % p] for i in range(len(x) - a)]
        if k % 7 == 0:
            x = x + x[:9] * 5 + x + [7] * 30
        yield x


def test_runs_against_brute_force(monkeypatch):
    found = list(texts())
    want = [brute(x) for x in found]
    for batch in (1, 500, P.BATCH):
        monkeypatch.setattr(P, "BATCH", batch)
        assert P.runs_of([np.array(x, np.int64) for x in found]) == want
    assert sum(map(len, want)) > 100


def test_suffix_tree():
    x = P.numbered(list(map(bytes, b"mississippi$")) and [bytes([c]) for c in b"mississippi$"])
    array, rank, common = P.ranked(x)
    suffixes = sorted(range(12), key=lambda i: x[i:].tolist())
    assert array.tolist() == suffixes and rank[array].tolist() == list(range(12))
    shared = lambda a, b: next((k for k, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))
    assert common.tolist() == [0] + [shared(x[a:].tolist(), x[b:].tolist()) for a, b in zip(suffixes, suffixes[1:])]
    starts, periods = P.branching(array, rank, common)
    plain = {(i, q) for i in range(12) for q in range(1, 7) if i + 2 * q <= 12 and (x[i : i + q] == x[i + q : i + 2 * q]).all() and (i + 2 * q == 12 or x[i + q] != x[i + 2 * q])}
    assert set(zip(starts.tolist(), periods.tolist())) == plain and len(starts) == len(plain)


def test_digests_against_brute_force(spark):
    rows = [(i, " ".join(f"w{v}" for v in x) + "\n\t") for i, x in enumerate(texts(250))] + [(7, "a b"), (None, "x " * 30), (9000, None), (9001, " \n")]
    got = [(r[0], tuple(r[1:])) for r in P.digests(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(((d, expected(d, t)) for d, t in rows), key=repr)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 10


def test_collapse_and_find(spark):
    rows = [(1, "start " + "a b c " * 10 + "end"), (2, "ab " * 23), (3, None), (4, "ab " * 24)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r[0]: r[1] for r in P.collapse(docs).collect()} == {1: "start a b c end", 2: ("ab " * 23).strip(), 3: None, 4: "ab"}
    assert {r[0]: [tuple(x) for x in r[1]] for r in P.find(docs).collect()} == {1: [(1, 30, 3)], 2: [], 3: [], 4: [(0, 24, 1)]}


@pytest.mark.parametrize("found, best", [([], None), ([(0, 30, 10), (40, 24, 8)], (0, 30, 10)), ([(0, 31, 10), (40, 28, 9)], (40, 28, 9))])
def test_strongest(found, best):
    assert P.strongest(found) == best


def test_long_periodic_text_is_quick():
    words = P.numbered([str(i % 40_000 if i > 5 else -i).encode() for i in range(200_000)])
    assert P.runs_of([words]) == [[(6, 199_994, 40_000)]]


def test_edges(spark):
    got = {r["doc_id"]: r["n_runs"] for r in P.digests(awkward(spark)).collect()}
    assert got == {None: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1, 7: 0}
    assert P.digests(empty(spark)).isEmpty() and P.collapse(empty(spark)).isEmpty() and P.digests(awkward(spark)).count() == 9
