"""The session's settings, and the tables of one folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """A session with UTC times and adaptive plans; a cluster's own settings stay."""
    b = SparkSession.builder.appName("gridsmith").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    for key, value in (("spark.master", master), ("spark.sql.shuffle.partitions", partitions), ("spark.driver.memory", memory)):
        if value is not None:
            b = b.config(key, str(value))
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session in
    one process gets a temporary one; a cluster, whose machines don't share those, is refused."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="gridsmith-")


class Tables:
    """Parquet tables of a folder by attribute: Tables(spark, path).orders."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what is read more than once is computed once, and a lost
    executor doesn't bring back the work above it."""
    path = f"{shared_folder(df.sparkSession)}/made/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
