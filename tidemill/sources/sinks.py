"""Tables by period that a run replaces in part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_periods(rows: DataFrame, path: str, keys: list[str], recomputed: DataFrame) -> None:
    """Of the Parquet table at ``path``, in folders by ``keys``, the periods in ``recomputed`` (``keys``; a row for each period)
    become what ``rows`` has of them, which is nothing where a period is empty now. Other periods keep their files, and
    ``rows`` of other periods are left out. Running it again changes nothing. Keys are dates, numbers or plain words.

    Spark replaces the folders that it writes; those of periods without rows are deleted afterwards."""
    periods = recomputed.select(*keys).distinct()
    own = rows.join(F.broadcast(periods), keys, "left_semi")
    own.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    written = rows.select(*keys).distinct()
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    for r in periods.join(written, keys, "left_anti").collect():  # empty periods of one run
        folder = jvm.org.apache.hadoop.fs.Path("/".join([path, *(f"{k}={r[k]}" for k in keys)]))
        folder.getFileSystem(conf).delete(folder, True)
