"""Readers: what they have seen, their taste, streaks and bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import centroid


def seen(interactions: DataFrame) -> DataFrame:
    """Distinct (user_id, story_id) with any interaction but an impression."""
    return interactions.filter("kind <> 'Impression'").select("user_id", "story_id").distinct()


def latest_opens(interactions: DataFrame, most: int = 40) -> DataFrame:
    """Distinct stories among each reader's last ``most`` opens and completed reads."""
    order = Window.partitionBy("user_id").orderBy(F.desc("occurred_at"), F.desc("story_id"))
    opens = interactions.filter(F.col("kind").isin("Open", "ReadComplete"))
    return opens.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).select("user_id", "story_id").distinct()


def taste(interactions: DataFrame, embeddings: DataFrame, most: int = 40) -> DataFrame:
    """(user_id, taste): mean embedding of the stories of ``latest_opens``. ``embeddings``: story_id, embedding."""
    return centroid(latest_opens(interactions, most).join(embeddings, "story_id"), ["user_id"], "embedding", "taste")


def streaks(interactions: DataFrame, local_date: Column) -> DataFrame:
    """(user_id, current, longest, last_active_date): runs of consecutive local days, the current one being the last.
    Days are made distinct before the window, so it orders a row for each user and day."""
    days = interactions.select("user_id", local_date.alias("d")).distinct()
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("d"))
    runs = days.withColumn("_run", F.date_sub("d", k)).groupBy("user_id", "_run").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("d").alias("last"))
    return runs.groupBy("user_id").agg(F.max_by("n", "last").alias("current"), F.max("n").alias("longest"), F.max("last").alias("last_active_date"))


def with_bookmarks(stories: DataFrame, bookmarks: DataFrame, user_id: int) -> DataFrame:
    """``is_bookmarked`` for one reader."""
    own = bookmarks.filter(F.col("user_id") == user_id).select("story_id", F.lit(True).alias("is_bookmarked")).distinct()
    return stories.join(own, "story_id", "left").withColumn("is_bookmarked", F.coalesce("is_bookmarked", F.lit(False)))
