import itertools
import math

import numpy as np

from credence.llm import langid as L
from tests.llm.fixtures import awkward, empty


def model():
    pieces = sorted({"a", "b", "ab", "ba", "aba", "th", "t", "h", "e", "the"})
    return L.train({"x": {"aba": 5, "abab": 2}, "y": {"the": 9, "heth": 3}}, {"x": 3, "y": 1}, pieces), pieces


def test_forward_sums_all_segmentations():
    m, pieces = model()
    row = {p: i for i, p in enumerate(pieces)}
    for word in ("abab", "theab", "bb", "zz"):
        for j in range(2):
            total = 0.0
            for cuts in itertools.product([0, 1], repeat=len(word) - 1):
                parts, at = [], 0
                for i, c in enumerate((*cuts, 1), 1):
                    if c:
                        parts.append(word[at:i])
                        at = i
                total += math.prod(max(L.FLOOR, m.p[row[p], j]) if len(p) == 1 and p in row else m.p[row[p], j] if p in row else (L.FLOOR if len(p) == 1 else 0.0) for p in parts)
            assert np.isclose(m.log_scores([word])[0, j], math.log(total))


def test_long_runs_and_long_pieces_are_summed_whole():
    pieces = sorted({"a", "b", "ab", "abababababababab"})
    m = L.train({"x": {"ab" * 40: 3, "ba": 1}, "y": {"b" * 30: 2}}, {"x": 1, "y": 1}, pieces)
    assert len(m.keys) == 16
    word = "ab" * 700 + "z"
    for j in range(2):
        logs = [0.0] + [-np.inf] * len(word)  # plain recursion in logarithms
        for i in range(1, len(word) + 1):
            for k in range(1, 17):
                if k <= i:
                    part = word[i - k : i]
                    p = m.p[pieces.index(part), j] if part in pieces else 0.0
                    p = max(p, L.FLOOR) if k == 1 else p
                    if p:
                        logs[i] = np.logaddexp(logs[i], logs[i - k] + np.log(p))
        assert np.isclose(m.log_scores([word, "ab" * 700 + "a"])[0, j], logs[-1])


def test_expected_counts_are_those_of_all_segmentations():
    m, pieces = model()
    one = L.Model(["x"], np.zeros(1), m.keys, m.place, m.p[:, :1])
    want, total = np.zeros(len(m.p)), 0.0
    for cuts in itertools.product([0, 1], repeat=3):
        parts, at = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append("abab"[at:i])
                at = i
        p = math.prod((max(L.FLOOR, m.p[pieces.index(x), 0]) if len(x) == 1 else m.p[pieces.index(x), 0]) if x in pieces else 0.0 for x in parts)
        total += p
        for x in parts if p else ():
            want[pieces.index(x)] += p
    assert np.allclose(L._expected(one, ["abab"], np.array([2.0]), 4), 2 * want / total)


def test_the_prior_counts_all_documents(spark):
    rows = [(i, "eau que" if i % 4 else "the thing", "fr" if i % 4 else "en") for i in range(800)]
    m = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20)
    assert abs(np.exp(m.prior[m.languages.index("fr")]) - 0.75) < 0.05


def test_probabilities_are_distributions():
    m, _ = model()
    assert np.allclose(m.p[:-1].sum(0), 1) and m.log_scores(["the"])[0, 1] > m.log_scores(["the"])[0, 0]


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(0)
    parts = {"en": ["th", "er", "ing", "on", "the"], "fr": ["eau", "ai", "é", "que", "ou"], "de": ["sch", "ung", "ü", "keit", "ge"]}
    rows = []
    for i in range(450):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(20)), lang))
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {d: x for d, _, x in rows}
    held = [r for r in got if r["held_out"]]
    assert len(got) == 450 and 50 < len(held) < 140 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_the_cache_bound_changes_nothing(monkeypatch):
    m, _ = model()
    texts = [["aba", "the"], ["heth", "ab", "aba"], [], ["the"] * 3]
    free = L.Scorer(m).texts(texts)
    monkeypatch.setattr(L, "CACHE", 1)
    s = L.Scorer(m)
    assert np.allclose(s.texts(texts), free) and np.allclose(s.texts(texts), free)


def test_edges(spark):
    docs = awkward(spark)
    got = L.identify(docs).collect()
    assert len(got) == docs.count() and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert L.identify(empty(spark)).isEmpty()
    assert {r["lang_pred"] for r in L.identify(docs.filter("doc_id in (1, 7)")).collect()} == {"und"}
    assert L.runs("A1b-" + "c" * 30) == ["a", "b", "c" * 30]


def test_numbers_are_no_letters(spark):
    assert L.runs("½ ² ① Ⅷ x² année½fin ª") == ["x", "année", "fin", "ª"]
    rows = [(i, ["der die das und", "the and of it"][i % 2] * 5, ["de", "en"][i % 2]) for i in range(60)] + [(100, "½ ² ① 12 _", "de")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100][0] == "und"
