"""Micro-batches: incremental ingest, trend windows, rates, streaks. Sources are folders of Parquet files; each run takes
what is there (``availableNow``) and its checkpoint lets the next one go on from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.storage import new_path

#: Out-of-order rows are waited for this long; what is older is dropped by the engine.
LATENESS = "1 day"


def read(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of a Parquet table: a folder of files, or one file named by its path."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path if _is_folder(spark, path) else f"{path.rsplit('/', 1)[0]}/{path.rsplit('/', 1)[1]}*")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run(stream: DataFrame, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", path: str | None = None) -> str:
    """Runs to the end of what is there; into Parquet files at ``path`` or through ``each`` micro-batch. Gives the path."""
    spark = stream.sparkSession
    path = path or new_path(spark, "stream")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint")
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(path)
    query.awaitTermination()
    return path


def trend_windows(events: DataFrame, ts: str, topic: str, width: str = "7 days", start: str = "4 days") -> DataFrame:
    """Counts by topic and tumbling window; 7 days from 4 days after the epoch begin on Mondays."""
    w = F.window(ts, width, startTime=start)
    return events.withWatermark(ts, LATENESS).groupBy(w.alias("w"), F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("n")).select("topic", F.col("w.start").alias("window_start"), "n")


def upsert_counts(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Each micro-batch of an updating aggregate goes to its own folder, so that a repeated batch replaces itself; the
    table is the last batch's row of each key."""

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def last_of(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def new_articles(stream: DataFrame, ts: str, key: str) -> DataFrame:
    """The first row of each key inside the watermark; the table itself is guarded by an anti-join in the batch."""
    return stream.withWatermark(ts, "14 days").dropDuplicatesWithinWatermark([key])


def _streak(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    current, longest, last = state.get if state.exists else (0, 0, -1)
    for day in sorted({int(d) for f in frames for d in f["day"]}):
        if day > last:
            current = current + 1 if day == last + 1 and last >= 0 else 1
            longest, last = max(longest, current), day
    state.update((current, longest, last))
    yield pd.DataFrame({"user_id": [key[0]], "current": [current], "longest": [longest], "last_day": [last]})


def streaks(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Each reader's streak after each micro-batch: state is three numbers a reader. Days are made distinct inside tasks
    before they are shuffled to the state; a day that comes late is ignored."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from pa.Table.from_batches([b]).group_by(["user_id", "day"]).aggregate([]).to_batches()

    days = events.select("user_id", F.unix_date(F.to_date(ts)).alias("day"))
    days = days.mapInArrow(distinct, days.schema)
    return days.groupBy("user_id").applyInPandasWithState(_streak, "user_id long, current int, longest int, last_day int", "current int, longest int, last int", "update", GroupStateTimeout.NoTimeout)
