import numpy as np

from credence.llm import neardup as N
from credence.llm.common import shingle_hashes
from tests.llm.fixtures import awkward, empty


def brute(rows):
    ids, sets = [], []
    for d, t in rows:
        ids.append(d)
        sets.append(set(shingle_hashes(t).tolist()))
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(ids[i]), root(ids[j])))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in zip(ids, sets)}


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    word = lambda: "w%d" % rng.integers(0, 4000)
    base = [[word() for _ in range(rng.integers(8, 160))] for _ in range(25)]
    passage = [word() for _ in range(40)]
    rows = []
    for k, b in enumerate(base):
        for _ in range(rng.integers(1, 5) if k else 90):  # one large group with edits of all strengths
            w = list(b)
            for _ in range(rng.integers(0, 8)):
                w[rng.integers(0, len(w))] = word()
            if rng.random() < 0.3:
                w = w + passage
            rows.append(" ".join(w))
    rows += [rows[3]] * 40 + [rows[5].upper(), "short one", "short  one", "x", None, "", " \n"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_the_rest_step_alone_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "HUB_ROUNDS", 0)
    rows = corpus(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_edges(spark):
    docs = awkward(spark)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in N.link(docs).orderBy("doc_id").collect()]
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 3, 4, True), (4, 3, 4, True), (5, 3, 4, False), (6, 1, 6, True), (7, 1, 7, True)]
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "None"]
    assert N.link(empty(spark)).isEmpty() and N.keep_one(empty(spark)).isEmpty()
    two = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v"), (3, "q r s t u v")], "doc_id long, text string")
    assert {r["component_id"] for r in N.link(two).collect()} == {1}


def test_repeated_ids_with_different_texts(spark):
    """No link is lost, in whatever order the rows come."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("b")), (2, text("b") + " x"), (3, text("a") + " y"), (4, text("c"))]
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [1, 0, 3, 2, 4]):
        got = N.link(spark.createDataFrame([rows[i] for i in order], "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_hot_keys_dealt_out(spark, monkeypatch):
    from credence.llm import common

    monkeypatch.setattr(common, "HOT", 1e-3)
    rows = corpus(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_signature_agreement_estimates_resemblance():
    rng = np.random.default_rng(0)
    agree = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 700, dtype=np.uint64)
        b = np.concatenate([a[:600], rng.integers(0, 2**63, 100, dtype=np.uint64)])  # resemblance 0.75
        agree.append((N.signature(a) == N.signature(b)).mean())
    assert abs(np.mean(agree) - 0.75) < 0.03 and min(agree) >= N.MATCHES / N.COORDINATES
