"""Stories from their members: aggregates, the primary article, cards and details, feeds, top story, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aggregates(members: DataFrame, sources: DataFrame) -> DataFrame:
    """By story: distinct and official sources, highest trust weight (0.5 without any), engagement, first and last time.
    Members are shuffled once, by story; a row for each story and source is made where they are, and so are its counts.
    ``sources`` is a dimension; Spark broadcasts it while it is small."""
    t = F.col("published_at")
    each = members.repartition("story_id").groupBy("story_id", "source_id").agg(F.sum(F.coalesce("engagement_score", F.lit(0))).alias("_e"), F.min(t).alias("_first"), F.max(t).alias("_last"))
    known = sources.groupBy("source_id").agg(F.max("is_official").alias("is_official"), F.max("trust_weight").alias("trust_weight"), F.count(F.lit(1)).alias("_n"))
    j = each.join(known, "source_id", "left")
    return j.groupBy("story_id").agg(
        F.count("source_id").cast("int").alias("distinct_source_count"), F.count_if("is_official").cast("int").alias("official_source_count"),
        F.coalesce(F.max("trust_weight"), F.lit(0.5)).alias("max_trust_weight"), F.sum(F.col("_e") * F.coalesce("_n", F.lit(1))).alias("engagement"), F.min("_first").alias("first_published_at"), F.max("_last").alias("last_activity_at"),
    )


def primary(members: DataFrame, sources: DataFrame) -> DataFrame:
    """(story_id, primary_source_id, position): official sources first, then the earliest article."""
    j = members.join(sources.select("source_id", "is_official"), "source_id", "left")
    first = F.min(F.struct((~F.coalesce("is_official", F.lit(False))).alias("o"), F.col("published_at").alias("t"), F.col("position").alias("position"), F.col("source_id").alias("s"))).alias("f")
    return j.groupBy("story_id").agg(first).select("story_id", F.col("f.s").alias("primary_source_id"), F.col("f.position").alias("position"))


def topics(members: DataFrame) -> DataFrame:
    """(story_id, topic_id, weight): the best weight of each topic."""
    return members.groupBy("story_id", "topic_id").agg(F.max("weight").alias("weight"))


def cards(stories: DataFrame, story_topics: DataFrame, summaries: DataFrame) -> DataFrame:
    """Stories with their summary, if any, and topics by weight, heaviest first, as a nested list."""
    nested = story_topics.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "topic_id"))).alias("t"))
    listed = F.coalesce(F.transform("t", lambda x: x["topic_id"]), F.array().cast("array<long>"))
    return stories.join(summaries, "story_id", "left").join(nested, "story_id", "left").select(*stories.columns, *[c for c in summaries.columns if c != "story_id"], listed.alias("topic_ids"))


def details(stories: DataFrame, members: DataFrame, sources: DataFrame, primaries: DataFrame) -> DataFrame:
    """Stories with the names of their members' sources, primary first, then by time; unknown sources have a label."""
    j = members.join(sources.select("source_id", "name"), "source_id", "left").join(primaries.select("story_id", F.col("position").alias("_p")), "story_id", "left")
    one = F.struct((F.col("position") != F.col("_p")).alias("later"), F.col("published_at").alias("t"), F.col("position").alias("p"), F.col("source_id").alias("s"), F.coalesce("name", F.lit("Bilinmeyen kaynak")).alias("name"))
    nested = j.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["name"]).alias("source_names"))
    return stories.join(nested, "story_id", "left")


def feed(df: DataFrame, category: str | None = None, within_hours: int = 0, now: Column | None = None) -> DataFrame:
    """Published stories that pass the given filters; each is left out if not given."""
    out = df.filter("status = 'Published'")
    if category:
        out = out.filter(F.col("category") == category)
    if within_hours > 0:
        out = out.filter(F.col("published_at") >= now - F.make_dt_interval(hours=F.lit(within_hours)))
    return out


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """One page, numbered from 1; ``size`` is held between 1 and ``most``."""
    size = min(max(size, 1), most)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """total_count, total_pages and has_next."""
    pages = F.ceil(F.col("total_count") / size)
    return df.agg(F.count(F.lit(1)).alias("total_count")).select("total_count", pages.alias("total_pages"), (pages > number).alias("has_next"))


def top_story(df: DataFrame, since: Column) -> DataFrame:
    """The most important, then most trusted published story since a moment; the latest of all where there is none."""
    published = df.filter("status = 'Published'")
    best = published.filter(F.col("published_at") >= since).orderBy(F.desc("importance_score"), F.desc("trust_score"), "story_id").limit(1).withColumn("_k", F.lit(1))
    latest = published.orderBy(F.desc("published_at"), "story_id").limit(1).withColumn("_k", F.lit(2))
    return best.unionByName(latest).orderBy("_k").limit(1).drop("_k")


def neighbours(df: DataFrame, group: str, order: list[Column], key: str) -> DataFrame:
    """``previous`` and ``next`` key in a ring of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    ring = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(group, key, F.coalesce(F.lag(key).over(w), F.last(key).over(ring)).alias("previous"), F.coalesce(F.lead(key).over(w), F.first(key).over(ring)).alias("next"))
