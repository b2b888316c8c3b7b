"""Scratch tables in the folder that driver and executors share, and skew-tolerant joins."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch between the JVM and Python while a scratch table is written: what both sides hold of the texts at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local folder only for a local master (tests), where nothing else needs to reach it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="noticeflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes for what runs inside; the session's settings come back after it."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Scratch:
    """Tables written once to the shared folder, so that lost executors cost no recomputation.

    They go when `drop` is called, and at the latest when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with small_batches(self.spark):
            df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name)), True)


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows with a table that has one row a key, where a key may hold a third of `many`.

    The second join key makes Spark exchange both sides for this join (an
    aggregate's own partitioning would be reused otherwise), and only such
    exchanges does AQE split when a partition is skewed.
    """
    left = many.withColumn("__spread", F.xxhash64(key))
    right = one.withColumn("__spread", F.xxhash64(key))
    return left.join(right, [key, "__spread"], how).drop("__spread")
