"""Topic trends: counts by calendar period, momentum against the period before, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import period_start, previous_start


def buckets(stories: DataFrame, period: str, topic: str = "topic") -> DataFrame:
    """(topic, period_start): story_count, source_count (sum over the stories, not distinct), weighted_importance."""
    return stories.groupBy(F.col(topic).alias("topic"), period_start(F.col("published_at"), period).alias("period_start")).agg(
        F.count(F.lit(1)).alias("story_count"), F.sum("source_count").alias("source_count"), F.sum("importance").alias("weighted_importance")
    )


def momentum(trend: DataFrame, period: str) -> DataFrame:
    """``momentum_percent`` of every bucket against the calendar period before it (100 where that is missing), in
    hundredths rounded half to even. A self-join and not ``lag``, as a topic may skip periods; both sides are already
    aggregated, so it moves a row for each topic and period."""
    before = trend.select("topic", F.col("period_start").alias("_start"), F.col("story_count").alias("_n"))
    joined = trend.withColumn("_start", previous_start(F.col("period_start"), period)).join(before, ["topic", "_start"], "left")
    change = F.rint((F.col("story_count") - F.col("_n")) / F.col("_n") * 10_000) / 100
    return joined.withColumn("momentum_percent", F.when(F.coalesce(F.col("_n"), F.lit(0)) == 0, 100.0).otherwise(change)).drop("_start", "_n")


def current(trend: DataFrame, period: str, now) -> DataFrame:
    """Momentum of the bucket that holds ``now``; 0 for all others."""
    held = F.col("period_start") == period_start(now, period)
    return momentum(trend, period).withColumn("momentum_percent", F.when(held, F.col("momentum_percent")).otherwise(0.0))


def history(trend: DataFrame, periods: int = 6) -> DataFrame:
    """For each topic its last ``periods`` buckets, ascending, as a nested list."""
    last = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("period_start")))
    recent = trend.withColumn("_k", last).filter(F.col("_k") <= periods)
    return recent.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("period_start", "story_count"))).alias("history"))


def bar_width(trend: DataFrame) -> DataFrame:
    """``width``: percent of the largest story count, 4 at least."""
    peak = trend.agg(F.greatest(F.max("story_count"), F.lit(1)).alias("_peak"))  # one row
    return trend.crossJoin(F.broadcast(peak)).withColumn("width", F.greatest(F.lit(4.0), F.col("story_count") / F.col("_peak") * 100)).drop("_peak")
