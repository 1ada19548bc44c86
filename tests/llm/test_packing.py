import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from credence.llm import packing as P
from tests.llm.fixtures import awkward, empty


def test_ids_equal_the_tokenizers():
    e = P.Encoder(P.tokenizer_path())
    texts = ["It's  \x1c\x85 weird\xa0don't'S 3½²a", "ÀÉ×÷µªº 123\x00\x7f é 日本語 ﬁ", "", " \n\t", "'ll're!!'s''t ", "a<|endoftext|>b", "The and attion, to thanedble the!! *** $5 | x", "Ωmega Straße"]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want == e.encode(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(t):
    e = P.encoder(P.tokenizer_path())
    assert e.encode([t]) == [e.whole(t)]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=12))
def test_patterns_place_everything(h):
    left = dict(h)
    for lengths, times in P.patterns(h, 60):
        assert times > 0 and sum(lengths) <= 60
        for x in lengths:
            left[x] -= times
    assert not any(left.values())


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(0)
    for _ in range(60):
        counts = {int(x): int(n) for x, n in zip(rng.integers(1, 30, 6), rng.integers(1, 4, 6))}
        sums = {0}
        for x, n in counts.items():
            sums |= {s + k * x for s in sums for k in range(1, n + 1)}
        room = int(rng.integers(1, 70))
        got = P.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(got) == max(s for s in sums if s <= room) and all(got.count(x) <= counts[x] for x in got)


def test_round_trip(spark):
    docs = awkward(spark)
    rows = P.pack(docs, capacity=64, with_ids=True).collect()
    e = P.Encoder(P.tokenizer_path())
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, np.frombuffer(e.whole(r["text"] or ""), "<u4").tolist() + [1]) for r in docs.collect())
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] or -1, r["piece"])):
        assert r["length"] == len(r["ids"]) <= 64 and r["start"] == 64 * r["piece"] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by.setdefault(r["doc_id"], []).append(r["ids"])
    n4 = [x for x in rows if x["doc_id"] == 4]
    assert len(n4) == 2 and n4[0]["ids"] == n4[1]["ids"]
    assert sorted((k is None, k or 0, sum(v[: 1 if k == 4 else None], [])) for k, v in by.items()) == sorted({(a, b, tuple(c)) for a, b, c in want} and [(a, b, c) for i, (a, b, c) in enumerate(want) if i == 0 or (a, b) != want[i - 1][:2]])
    seq: dict = {}
    for r in rows:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64
    assert P.pack(empty(spark)).isEmpty()
