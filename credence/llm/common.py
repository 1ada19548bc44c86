"""What the operators share: table reading, cut lineage, word bytes and word hashes."""

from __future__ import annotations

import json
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word, as the contracts have it: anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: bytes.split() without arguments cuts at exactly these six ASCII characters.
UPPER_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        path = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The plan starts anew at that table: lost executors cost a reread, never a recomputation of what stands above,
    and the optimiser knows its size. `forget` deletes a session's tables when its results are stored.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/credence/{spark.sparkContext.applicationId}"


def table_path(spark: SparkSession, name: str) -> str:
    """A new table's place in the shared folder."""
    return f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Delete all tables that this application's operators wrote; to be called once its results are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than this share of all rows is hot; there are 1 / HOT of them at most.
HOT = 1 / 4096


def spread_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined to `table` on `key`; table has one row a key and, in `count`, how many of the `total` rows have it.

    The rows of a hot key are dealt out over as many places as they make HOT shares, and its row of `table` goes to each.
    The list of hot keys is broadcast: 1 / HOT of them at most.
    """
    many = int(HOT * total) + 1
    parts = F.ceil(F.col(count) / many).cast("int")
    hot = F.broadcast(table.filter(F.col(count) > many).select(F.col(key).alias("__key"), parts.alias("__parts")))
    place = F.pmod(F.xxhash64(*rows.columns), F.coalesce("__parts", F.lit(1))).cast("int")
    dealt = rows.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__place", place).drop("__key", "__parts")
    copied = table.withColumn("__place", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(copied.drop(count), [key, "__place"]).drop("__place")


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of constants, made within the JVM: one literal, no Python or RDD behind it."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    fields = ", ".join("{}: {}".format(*x.split()) for x in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, whatever else the table has; a null text stays null."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def parallel(df: DataFrame) -> DataFrame:
    """df itself if its scan gives each core work, else dealt out evenly (small inputs of one file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= min(cores, 4) else df.repartition(cores)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


#: Odd multipliers, one for each place in a window of five.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def window_hashes(h: np.ndarray, width: int = 5) -> np.ndarray:
    """64-bit hashes of all windows of `width` (at most five) words; empty if there are fewer words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for k in range(width):
        y = h[k : k + n] * PLACES[k]
        y ^= y >> np.uint64(29)
        x += y * PLACES[(k + 1) % len(PLACES)]
    x ^= x >> np.uint64(32)
    x *= PLACES[0]
    x ^= x >> np.uint64(29)
    return x


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles, A-Z lower-cased.

    With fewer words than `width`, the whole sequence is one shingle; without words, none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00" + b" ".join(words))], np.uint64)
    return np.unique(window_hashes(word_hashes(words), width))
