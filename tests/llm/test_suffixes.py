import hashlib

import numpy as np
import pytest

from credence.llm import suffixes as S
from tests.llm.fixtures import awkward, empty

SCHEMA = "doc_id long, text string"


def brute(rows):
    """Each row by looking up all its strings of 50 bytes among those of smaller ids."""
    out = []
    strings = [(d, {b[i : i + 50] for i in range(len(b) - 49)}) for d, t in rows if d is not None for b in [(t or "").encode()]]
    for d, t in rows:
        b = (t or "").encode()
        smaller = set().union(*(s for e, s in strings if d is not None and e < d))
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if b[i : i + 50] in smaller:
                gone[i : i + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(n=150):
    """Passages of all lengths about 50 bytes, few letters, runs of one letter, copies."""
    rng = np.random.default_rng(5)
    passages = ["".join(rng.choice(list("abcé \n"), rng.integers(30, 140))) for _ in range(25)] + ["a" * 120, "ab" * 60, "é" * 60]
    rows = []
    for i in range(n):
        own = ["".join(rng.choice(list("abcdefgh ü"), rng.integers(0, 60))) for _ in range(4)]
        taken = [passages[k] for k in rng.integers(0, len(passages), 3)]
        cut = [p[rng.integers(0, 20) :][: rng.integers(20, 140)] for p in taken]
        rows.append((int(rng.permutation(n)[0]) + 1000 * i, "".join(x for pair in zip(own, cut) for x in pair)))
    rows += [(5, rows[3][1]), (10**9, rows[7][1]), (10**9 + 1, "x" * 49), (10**9 + 2, "x" * 50), (10**9 + 3, "x" * 51), (6, ""), (7, None), (None, rows[1][1])]
    return rows + [rows[4], (rows[4][0], rows[9][1]), (rows[4][0], rows[4][1][:100])]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert got(S.digests(spark.createDataFrame(rows, SCHEMA))) == want
    assert sum(r[2] > 0 for r in want) > 80


@pytest.mark.parametrize("chunk, bucket, limit", [(400, 1 << 24, 1 << 26), (400, 2000, 1 << 26), (300, 1 << 24, 600), (300, 3000, 300)])
def test_chunks_buckets_and_second_rounds_change_nothing(spark, monkeypatch, chunk, bucket, limit):
    rows = corpus(60)
    for name, value in (("CHUNK", chunk), ("BUCKET", bucket), ("LIMIT", limit)):
        monkeypatch.setattr(S, name, value)
    rounds = []
    meet = S._meet
    monkeypatch.setattr(S, "_meet", lambda *a: rounds.append(a) or meet(*a))
    assert got(S.digests(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)
    assert len(rounds) == 1 + (limit < 1000)


@pytest.mark.parametrize("shallow", [8, 16, 24])
def test_sorting(shallow):
    rng = np.random.default_rng(shallow)
    for k in range(150):
        n = int(rng.integers(1, 300))
        buf = S.padded([bytes(rng.integers(0, rng.integers(1, 4), n).astype(np.uint8))])
        starts = rng.integers(0, n, rng.integers(1, 120)) % (5 if k % 2 else n)
        lengths = np.clip(rng.integers(0, 60, len(starts)), 0, n - np.minimum(starts, n))
        order, common = S.deep_shallow(buf, starts, lengths, shallow)
        strings = [bytes(buf[starts[i] : starts[i] + lengths[i]]) for i in order]
        assert strings == sorted(strings)
        same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common.tolist() == [0] + [same(a, b) for a, b in zip(strings, strings[1:])]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    passage = bytes(rng.integers(97, 100, 400).astype(np.uint8))
    texts = [bytes(rng.integers(97, 100, k).astype(np.uint8)) + passage for k in (0, 13, 77)]
    buf, ends = S.padded(texts), np.cumsum([len(t) for t in texts])
    at, head, tail = S.anchors(buf, np.concatenate(([0], ends[:-1])), ends)
    owned = {p: a - p for a, h, t in zip(at.tolist(), head.tolist(), tail.tolist()) for p in range(h, t + 1)}
    assert sorted(owned) == [p for a, z in zip([0, *ends[:-1]], ends) for p in range(a, z - 49)]
    assert all(len({owned[e - 400 + k] for e in ends.tolist()}) == 1 for k in range(351))


def test_clean(spark):
    passage = "This passage of more than fifty bytes stands in both of them, É."
    rows = [(1, f"one {passage} end", "a"), (2, f"é {passage}!", "b"), (3, None, "c"), (None, passage, "d"), (2, "other", "e")]
    out = S.clean(spark.createDataFrame(rows, SCHEMA + ", spans string"))
    assert out.columns == ["doc_id", "text", "spans"]
    assert {r["spans"]: r["text"] for r in out.collect()} == {"a": rows[0][1], "b": "é!", "c": None, "d": passage, "e": "other"}


def test_edges(spark):
    docs = awkward(spark)
    found = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in S.digests(docs).collect()}
    assert len(found) == 8 and not any(found.values())
    assert S.digests(docs).count() == docs.count() and S.clean(docs).columns == docs.columns
    assert S.digests(empty(spark)).isEmpty() and S.clean(empty(spark)).isEmpty()
