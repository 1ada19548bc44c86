"""A sink of snapshots: all of them by epoch, and the latest of each problem, upserted by bucket.

Below the sink's folder:

* history/epoch=E: what micro-batch E brought, written over if it is run again;
* latest/epoch=E/bucket=B: the latest snapshots of the problems of bucket B, as they were after E;
* log/epoch=E: which epoch's folder holds each bucket, in one line. An epoch counts once its line is written.

A micro-batch reads and writes the buckets that it touches and no others, so what it costs goes by its own problems, not by
the history. An epoch that is in the log is not run again. Folders that none of the last KEEP lines names are deleted, after the line
is written; a reader that began before has so many epochs' time to end.

Nulls and edges: rows without a problem are in the history alone; of snapshots with the same turn the later epoch's counts, within one
the greatest; a turn earlier than the stored one changes nothing; an empty micro-batch writes an empty history and its line.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

#: Buckets of problems, and epochs that stay readable.
BUCKETS, KEEP = 32, 3


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def epochs(spark: SparkSession, root: str) -> list[int]:
    """The epochs in the log, in order."""
    path, files = _files(spark, f"{root}/log")
    if not files.exists(path):
        return []
    found = [f.getPath() for f in files.listStatus(path)]
    done = [p for p in found if files.exists(_files(spark, f"{p}/_SUCCESS")[0])]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def _line(spark: SparkSession, root: str, epoch: int) -> dict[int, int]:
    held = json.loads(spark.read.text(f"{root}/log/epoch={epoch}").first()[0])
    return {int(k): v for k, v in held.items()}


def _read(spark: SparkSession, root: str, held: dict[int, int]) -> DataFrame | None:
    """The latest snapshots of these buckets, each from its epoch."""
    paths = [f"{root}/latest/epoch={e}/bucket={b}" for b, e in sorted(held.items())]
    return spark.read.option("basePath", f"{root}/latest").parquet(*paths) if paths else None


def upsert(batch: DataFrame, root: str, epoch: int, buckets: int = BUCKETS) -> None:
    """Take in a micro-batch (problem_id, turn_id, snapshot)."""
    spark = batch.sparkSession
    done = epochs(spark, root)
    if epoch in done:
        return
    batch.write.mode("overwrite").parquet(f"{root}/history/epoch={epoch}")
    rows = spark.read.schema(batch.schema).parquet(f"{root}/history/epoch={epoch}").filter("problem_id is not null")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("problem_id"), F.lit(buckets)).cast("int")).withColumn("epoch", F.lit(epoch))
    held = _line(spark, root, done[-1]) if done else {}
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
    stored = _read(spark, root, {b: held[b] for b in touched if b in held})
    if stored is not None:
        rows = rows.unionByName(stored.select(*rows.columns))
    newest = F.max_by(F.struct("turn_id", "snapshot"), F.struct("turn_id", "epoch", "snapshot"))
    merged = rows.groupBy("bucket", "problem_id").agg(newest.alias("x")).select("bucket", "problem_id", "x.turn_id", "x.snapshot")
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/latest/epoch={epoch}")
    held |= dict.fromkeys(touched, epoch)
    spark.range(1).select(F.lit(json.dumps(held)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{root}/log/epoch={epoch}")
    _clean(spark, root, [*done, epoch])


def _clean(spark: SparkSession, root: str, done: list[int]) -> None:
    """Delete old lines, and buckets that no line left names."""
    kept = [_line(spark, root, e) for e in done[-KEEP:]]
    named = {(e, b) for line in kept for b, e in line.items()}
    old = _line(spark, root, done[-KEEP - 1]) if len(done) > KEEP else {}
    gone = [f"{root}/latest/epoch={e}/bucket={b}" for b, e in old.items() if (e, b) not in named]
    gone += [f"{root}/log/epoch={e}" for e in done[:-KEEP]]
    for x in gone:
        path, files = _files(spark, x)
        files.delete(path, True)


def write(df: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Take in a stream of snapshots until its input ends."""
    return df.writeStream.foreachBatch(lambda batch, epoch: upsert(batch, root, epoch, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, root: str) -> DataFrame:
    """problem_id, turn_id, snapshot: the latest of each problem, as of the last epoch in the log."""
    done = epochs(spark, root)
    found = _read(spark, root, _line(spark, root, done[-1])) if done else None
    if found is None:
        return spark.createDataFrame([], "problem_id string, turn_id long, snapshot string")
    return found.select("problem_id", "turn_id", "snapshot")


def history(spark: SparkSession, root: str) -> DataFrame:
    """All snapshots, with their epochs."""
    return spark.read.parquet(f"{root}/history")
