import itertools

import numpy as np
import pytest

from credence.llm import common, repeats as R
from tests.llm.fixtures import awkward, empty


def brute(rows, least, unit="sentence"):
    """Marked characters, by looking at all runs of all documents."""

    def found(text, separator):
        u = R.cut(text, separator)
        for i in range(len(u)):
            for j in range(i, len(u)):
                if sum(x[3] for x in u[i : j + 1]) >= least:
                    yield i, j, " ".join(x[2] for x in u[i : j + 1]), u
                    break

    seen, out = {}, {}
    for d, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        gone, mine = set(), {}
        for i, j, g, u in found(text, R.CUTS[unit]):
            if seen.setdefault(g, d) != d:
                gone |= set(range(u[i][0], u[j][1]))
        for i, j, g, u in found(text, R.CUTS["paragraph" if unit == "paragraph" else "line"]):
            if g in mine and max(i, mine[g] + 1) <= j:
                gone |= set(range(u[max(i, mine[g] + 1)][0], u[j][1]))
            mine.setdefault(g, j)
        out[d] = gone
    return out


def characters(text):
    return set(itertools.chain(*(range(*map(int, x.split(":"))) for x in text.split(",") if x)))


@pytest.mark.parametrize("unit", ["sentence", "line", "paragraph"])
def test_against_brute_force(spark, unit):
    rng = np.random.default_rng(0)
    bits = [" ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(1, 9))) + str(rng.choice(["", ".", "!?"])) for _ in range(60)]
    seps = [" ", "\n", "\n\n", " | "]
    rows = [(i, "".join(x for b in rng.choice(bits, rng.integers(1, 9)) for x in (b, str(rng.choice(seps))))) for i in range(80)]
    rows += [(80, "W1  w2\tw3 w4. x"), (81, "w1, w2 w3 w4.")]
    got = {r["doc_id"]: characters(r["removed"]) for r in R.per_document(spark.createDataFrame(rows, "doc_id long, text string"), unit, 3).collect()}
    assert got == brute(rows, 3, unit) and sum(map(bool, got.values())) > 10


def test_passages_however_laid_out(spark):
    """Inside a longer line, wrapped into short lines, with one word changed, in capitals."""
    s = ["The first sentence of it has eight words.", "A second one follows with a few more words than that.", "Then comes the third, and it is of a middling length.", "The end."]
    rows = [(1, "Own beginning. " + " ".join(s)), (2, "words before it " + " ".join(s) + " words after it"), (3, "x\n" + "\n".join(s)), (4, " ".join(s).replace("first", "1st")), (5, " ".join(s).upper()), (6, "Nothing of that kind is here at all, but words enough to make a run of them.")]
    got = {r["doc_id"]: r["chars_removed"] for r in R.per_document(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[6] == 0 and all(got[i] > 100 for i in (2, 3, 4, 5))


def test_within_a_document_the_first_occurrence_stays_whole(spark):
    rows = [(1, "\n".join(["a b c"] * 5)), (2, "x. x. x. x. x. x. x. x.")]
    got = {r["doc_id"]: r["text"] for r in R.clean(spark.createDataFrame(rows, "doc_id long, text string"), min_words=6).collect()}
    assert got == {1: "a b c\na b c\n", 2: rows[1][1]}


def test_common_digests_are_dealt_out(spark, monkeypatch):
    rows = [(i, f"own {i}\nthis line is in every one of them") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(common, "HOT", 0.01)
    some = {tuple(r) for r in R.per_document(docs, min_words=5).collect()}
    monkeypatch.setattr(common, "HOT", 1.0)
    assert some == {tuple(r) for r in R.per_document(docs, min_words=5).collect()} and sum(r[1] for r in some) == 49


def test_clean(spark):
    rows = [(1, "a b c\nown line\na b c"), (2, "A  b c\nx"), (3, None), (None, "a b c")]
    got = {r["doc_id"]: r["text"] for r in R.clean(spark.createDataFrame(rows, "doc_id long, text string"), min_words=3).collect()}
    assert got == {1: "a b c\nown line\n", 2: "x", 3: None, None: "a b c"}


def test_edges(spark):
    docs = awkward(spark)
    got = {r["doc_id"]: r["n_removed"] for r in R.per_document(docs, min_words=5).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0, 7: 0}
    out = R.clean(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert R.per_document(empty(spark)).isEmpty() and R.clean(empty(spark)).isEmpty()
