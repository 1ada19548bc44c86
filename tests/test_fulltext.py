import numpy as np
import pytest

from credence.operators import retrieval as R
from credence.operators.fulltext import TextIndex

DOCS, QUERIES = "doc_id long, turn long, text string", "query_id long, text string"


def corpus(n=400):
    rng = np.random.default_rng(0)
    words = np.array([f"w{i}" for i in range(300)])
    odds = 1 / np.arange(1, 301)
    draw = lambda k: " ".join(rng.choice(words, k, p=odds / odds.sum()))
    docs = [(i, i % 7, draw(rng.integers(1, 60))) for i in range(n)] + [(n, 1, None), (n + 1, 1, ""), (n + 2, 5, "rare w1 w1"), (n + 3, 5, "rare w1 w1"), (n + 4, 2, "only here")]
    queries = [(i, draw(rng.integers(1, 25))) for i in range(40)] + [(100, "rare"), (101, "unknown"), (102, None), (103, "only w0"), (104, "W1 w1 rare")]
    return docs, queries


@pytest.mark.parametrize("top", [1, 6, 50])
def test_the_same_as_scoring_everything(spark, tmp_path, top):
    docs, queries = corpus()
    d, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(queries, QUERIES)
    index = TextIndex.create(d, f"file://{tmp_path}/index")
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in index.search(q, top).collect()}
    want = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in R.bm25(d, q, top).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-8 for k in got)
    assert len(got) > 40 * top * 0.8
    if top == 1:
        assert index.share_read(q, top) < 0.3
    assert index.search(q.limit(0)).isEmpty() and index.share_read(q.limit(0)) == 0


def test_empty(spark, tmp_path):
    index = TextIndex.create(spark.createDataFrame([(1, 1, None)], DOCS), f"file://{tmp_path}/index")
    q = spark.createDataFrame([(1, "a b")], QUERIES)
    assert index.search(q).isEmpty()
    index = TextIndex.create(spark.createDataFrame([(1, 1, "a c"), (1, 4, "a d d"), (None, 2, "b")], DOCS), f"file://{tmp_path}/repeated")
    assert [(r["doc_id"], r["turn"]) for r in index.search(q).orderBy("rank").collect() if r["doc_id"]] == [(1, 4)]
