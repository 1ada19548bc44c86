import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from credence.llm import quality as Q
from tests.llm.fixtures import awkward, empty

W = re.compile(r"[^\x20\x09-\x0D]+")


def naive(t):
    words = W.findall(t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if W.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#|é\x1c\xa0", max_size=60))
def test_counts(t):
    assert Q.count(t)[:5] == naive(t)


def labelled(spark, n=600):
    rows = [(i, " ".join(f"w{(i * 31 + j * 17) % 997}" + ("***" if i % 4 == 0 else "") for j in range(40)), "en", "s", 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")


def test_learned_list(spark):
    docs, labels = labelled(spark)
    rules = Q.learn_rules(docs, labels)
    assert rules and rules == Q.learn_rules(docs, labels)
    got = {r["doc_id"]: r["kept"] for r in Q.judge(docs, labels).collect()}
    assert all(got[i] == (i % 4 != 0) for i in got)
    assert {r["doc_id"] for r in Q.filter_documents(docs, labels).collect()} == {i for i in got if got[i]}
    assert Q.filter_documents(docs, labels).columns == docs.columns


def test_pruning_keeps_rules_short():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(900, len(Q.STATISTICS)))
    bad = x[:, 1] > 0.8
    rules = Q.learn(x, bad)
    assert rules[0].conditions[0][0] == Q.STATISTICS[1] and len(rules[0].conditions) == 1
    assert Q.learn(x, np.zeros(900, bool)) == [] and Q.learn(x[:0], bad[:0]) == []


def test_edges(spark):
    docs, labels = awkward(spark), spark.createDataFrame([(4, 0, None), (None, 0, 0), (5, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.judge(docs, labels).collect()
    assert len(got) == docs.count() and all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] in (1, 2, 3, 6))
    assert Q.judge(empty(spark), labels).isEmpty() and Q.filter_documents(empty(spark), labels).isEmpty()
    assert Q.judge(docs, labels.limit(0)).count() == docs.count()
    assert Q.filter_documents(docs.withColumn("text", F.lit("a b c d e f g h i j k l")), labels).columns == docs.columns
