"""Vectors as arrays: cosine similarity, length, centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty or zero vectors and unequal widths; sums in double precision."""
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(usable, F.coalesce(F.try_divide(dot(a, b), length), F.lit(0.0))).otherwise(0.0)


def unit(v: Column) -> Column:
    """Scaled to length one; a zero vector is unchanged."""
    length = F.sqrt(dot(v, v))
    return F.when(length == 0, v).otherwise(F.transform(v, lambda x: (x.cast("double") / length).cast("float")))


def centroid(df: DataFrame, keys: list[str], vector: str, name: str = "centroid", kind: str = "float") -> DataFrame:
    """Mean of the vectors that aren't empty, by ``keys``, with components of ``kind``; null where their widths differ. Components are summed before
    the shuffle, so a key of any size is no more than its width in rows."""
    given = df.filter(F.size(vector) > 0)
    long = given.select(*keys, F.size(vector).alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    summed = long.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.min("_w").alias("_lo"), F.max("_w").alias("_hi"))
    joined = summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return joined.select(*keys, F.when(F.col("_lo") == F.col("_hi"), F.transform("_v", lambda x: x["_m"].cast(kind))).alias(name))
