"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import BATCH_BYTES, Stored, new_path, small_batches, stored  # noqa: F401

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def put(a: np.ndarray, kind: type) -> bytes:
    """Numbers as bytes, first bytes first, then all second ones and so on: small numbers compress well so."""
    a = np.ascontiguousarray(a, kind)
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def get(b: bytes, kind: type) -> np.ndarray:
    """What ``put`` was given."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pieces(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """A batch in parts: its texts become Python's a few at a time, whatever the size of a batch."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, begin and end of each run of equal keys; none of an empty array."""
    if len(keys):
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        yield from zip(keys[np.concatenate(([0], cuts))].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Slots of a sieve.
SLOTS = 1 << 20


def sieve(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``key`` may be in ``ids``, and those whose isn't for certain (null keys included). Only
    the slots (of SLOTS) that the hashes of ``ids`` fall in are broadcast, so its size is bounded at any number of ids; as
    they fill up, more rows are in the first part, which is to be joined."""
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(SLOTS)).cast("int").alias("_slot")
    taken = F.broadcast(ids.select(slot).distinct())
    marked = df.withColumn("_slot", F.when(F.col(key).isNotNull(), slot))
    return marked.join(taken, "_slot", "left_semi").drop("_slot"), marked.join(taken, "_slot", "left_anti").drop("_slot")


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "left", total: int | None = None) -> DataFrame:
    """Join ``left`` with ``right`` on ``key``, which is unique in ``right``; ``weight`` says how many rows of ``left``
    have that key, ``total`` how many rows it has, if that is known.

    The keys that hold over a 500th of all rows are at most 500 by that definition, so they are broadcast, and no task
    gets all rows of a hot key; the other keys are joined by a shuffle.
    """
    whole, most = right.agg(F.sum(weight), F.max(weight)).first()
    bound = max(((whole or 0) if total is None else total) // 500, 1000)
    if (most or 0) <= bound:
        return left.join(right.drop(weight), key, how)
    right_cols = [c for c in right.columns if c not in (key, weight)]
    hot = right.filter(F.col(weight) > bound).withColumn("_hot", F.lit(True)).drop(weight)
    cold = right.filter(F.col(weight) <= bound).drop(weight)
    marked = left.join(F.broadcast(hot), key, "left")
    done = marked.filter("_hot").drop("_hot")
    rest = marked.filter("_hot IS NULL").drop("_hot", *right_cols).join(cold, key, how)
    return done.unionByName(rest.select(done.columns))
