import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.llm import audit as A, common
from tests.llm.fixtures import awkward, empty

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Each document walked through each order."""
    docs = [(d, t or "", s or "") for d, t, s in docs]

    def fails(d, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield len(w) < 50
        yield 100 * len(set(w)) < 65 * len(w)
        yield 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)
        yield bool(re.search(r"[#$%&*|]", t))
        yield d is not None and any(e is not None and e < d and u == t for e, u, _ in docs)

    out = {(p, "".join(o), k): [0] * 7 for p in {s for *_, s in docs} for o in itertools.permutations("ABCDE") for k in range(1, 6)}
    for d, t, s in docs:
        failed = dict(zip("ABCDE", fails(d, t)))
        good, toxic = (any(i is not None and i == d and x[at] == 1 for i, *x in labels) for at in (0, 1))
        for order in itertools.permutations("ABCDE"):
            gone = False
            for k, f in enumerate(order, 1):
                row = out[s, "".join(order), k]
                now = failed[f] and not gone
                row[2] += failed[f] and gone
                gone |= failed[f]
                row[0] += not gone
                row[1] += now
                row[3] += failed[f] and sum(failed.values()) == 1
                row[4] += now and good
                row[5] += now and toxic
    for (p, o, k), row in out.items():
        row[6] = sum(r[1] for (q, u, j), r in out.items() if q == p and u[j - 1] == o[k - 1])
    return {k: tuple(map(int, v)) for k, v in out.items()}


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in df.collect()}


def corpus(n=120):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(80)] + ["UPPER", "Mixed", "a#b", "100%", "é"]
    texts = [" ".join(rng.choice(words[: rng.integers(2, 86)], rng.integers(0, 90))) for _ in range(n)]
    texts += texts[:20] + [None, "", None, "#", "É" * 60]
    docs = [(int(i) if i % 17 else None, t, [None, "", "s1", "s2"][i % 4]) for i, t in enumerate(texts)] + [(3, texts[3], "s1"), (3, texts[9], "s2"), (3, texts[3], "s1")]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(1, n, 2)] + [(3, 0, 0), (3, 1, 1), (None, 1, 1), (5, None, None)]
    return docs, labels


def test_against_brute_force(spark):
    docs, labels = corpus()
    assert got(A.interactions(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))) == brute(docs, labels)


def test_matrices():
    m = A.matrices()
    assert all(x.shape == (32, 600) and x.dtype == np.int64 for x in m.values())
    assert (m["kept"][0] == 1).all() and m["removed"].sum() == 31 * 120 and m["unique"].sum() == 5 * 120
    first = m["kept"][:, ::5] + m["removed"][:, ::5]
    assert (first == 1).all() and not m["redundant"][:, ::5].any()


def test_common_texts_are_dealt_out(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the same" if i % 3 else f"own {i}", "s") for i in range(90)], DOCS)
    labels = spark.createDataFrame([], LABELS)
    monkeypatch.setattr(common, "HOT", 0.01)
    some = got(A.interactions(docs, labels))
    monkeypatch.setattr(common, "HOT", 1.0)
    assert some == got(A.interactions(docs, labels)) and some["s", "EABCD", 1][1] == 59


@pytest.mark.parametrize("text, mask", [(b"", 1), (b"x " * 50, 2), ("É".encode() * 3, 1), (b"A" + b" b" * 9, 3 | 4), (b"a|b", 9)])
def test_own_mask(text, mask):
    assert A.own_mask(text) == mask


def test_edges(spark):
    docs, labels = awkward(spark), spark.createDataFrame([(4, 1, 0, "x")], LABELS + ", text string")
    out = got(A.interactions(docs, labels))
    assert {p for p, *_ in out} == {"a", "b", ""} and len(out) == 1800
    assert out["b", "DEABC", 1][0] == 4 and out["", "EABCD", 1][1] == 1
    assert A.interactions(empty(spark), labels).isEmpty()
    assert got(A.interactions(docs, labels.limit(0)))["a", "ABCDE", 1][4] == 0
    assert got(A.interactions(docs.withColumn("lang", F.lit("all")), labels, "lang"))["all", "ABCDE", 1][0] == 1
