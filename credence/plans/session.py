"""Sessions and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build(app: str = "credence", **conf: str) -> SparkSession:
    """A session with the settings that the operators assume; master and resources come from spark-submit."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    b = SparkSession.builder.appName(app)
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return path.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """Where this application's operators write what cuts lineage."""
    return f"{shared_dir(spark)}/graph/{spark.sparkContext.applicationId}"


def table_path(spark: SparkSession, name: str) -> str:
    """A new table's place there."""
    return f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Delete what this application's operators wrote to cut lineage; to be called once its results are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
