"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset and all runs in one process, a temporary folder; on a cluster, where
    other machines can't see such a folder, an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidemill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: what follows neither recomputes it nor depends on a lost executor."""
    path, schema = new_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


#: Bytes of rows that a Python worker is sent at once, by a session with ``small_batches``.
BATCH_BYTES = 1 << 22


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends rows to Python workers in batches of about BATCH_BYTES, or fewer if it did so before.
    Spark's own limit is 10,000 rows, of any size: such a batch of texts is held by the executor and by its worker, with what
    each makes of it. Batches are only a way of sending, no result depends on them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(spark.conf.get(name)))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


@contextmanager
def rows_per_file(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables that are written inside have so many rows in a file at most: what is held of large rows, by writer and reader, is a file's."""
    key = "spark.sql.files.maxRecordsPerFile"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Stored:
    """The intermediate tables of one job; those that no later step reads are deleted."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, new_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """As ``stored``, in a folder for each value of ``by``, whose files alone a filter on it reads."""
        writer, schema = df.write.option("compression", "zstd"), df.schema
        (writer.partitionBy(by) if by else writer).parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name)).select(*df.columns)

    def drop(self, name: str, **part: object) -> None:
        """Delete a table, or its rows with the value of ``by``."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.path(name), *(f"{k}={v}" for k, v in part.items())]))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
