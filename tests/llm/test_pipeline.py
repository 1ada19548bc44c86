import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from credence.llm import mixing, neardup, packing, pii, quality


def test_stages_and_the_whole(spark, tmp_path):
    """Each stage against the operator's own result on the stage before; the whole run against the stages in a row."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(160):
        t = " ".join(f"w{x}" for x in rng.integers(0, 3000, 60))
        if i % 8 == 0:
            t = t.replace(" ", "*** ")
        if i % 8 == 1:
            t += f" call +1 (017) 555-{i:04d}"
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(200 + i, rows[2][1] + " tail", "en", "s0", 1) for i in range(5)] + [(300, None, None, None, None), (301, "", "en", "s1", 0)]
    sf = f"file://{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in P.STAGES] == ["quality rules", "MinHash near-dedup", "PII", "mixing", "packing"]
    got = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        path = f"{tmp_path}/{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got.append(docs)
        assert docs.columns == names or k == 4
    a, b, c, d, e = ([r for r in x.collect()] for x in got)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    first = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r["doc_id"] for r in a} == {r["doc_id"] for r in quality.judge(first, labels).collect() if r["kept"]} and all(r["doc_id"] % 8 or r["doc_id"] >= 200 for r in a) and {r[0] for r in rows if 0 < r[0] % 8 and r[0] < 160} <= {r["doc_id"] for r in a}
    assert {r["doc_id"] for r in b} == {r["doc_id"] for r in neardup.link(got[0]).collect() if r["kept"]} and not any(200 <= r["doc_id"] < 205 for r in b)
    assert all("<PHONE>" in r["text"] and not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in c if r["doc_id"] % 8 == 1 and r["doc_id"] < 160)
    times = {r["doc_id"]: r["copies"] for r in mixing.copies(got[2]).collect()}
    assert sorted(r["doc_id"] for r in d) == sorted(i for i, n in times.items() for _ in range(n))
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in e) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packing.pieces(got[3]).collect())
    whole = P.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in e)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _written(spark, path, rows, labels=(), extra=()):
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in extra:
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return f"file://{path}"


def test_an_empty_table_and_nothing_but_nulls(spark, tmp_path):
    assert P.run(spark, _written(spark, tmp_path / "a", [])).isEmpty()
    assert P.run(spark, _written(spark, tmp_path / "b", [(1, None, None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0)])).isEmpty()


def test_null_ids_repeated_rows_clashing_columns_and_no_labels(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1), "en", "s", 1), (1, text(1), "en", "s", 1), (None, text(2), "en", None, 1), (3, text(3), None, "t", None), (4, text(1) + " more", "en", "s", 1)]
    extra = ("kept", "rule", "copies", "node", "digest", "__q_", "salt", "length", "n")
    sf = _written(spark, tmp_path, rows, extra=extra)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = out
    ids = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert {i for i, _ in ids} <= {1, 3, None} and (1, text(1)) in ids and not any(i == 4 for i, _ in ids)
    packed = P.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in ids}
