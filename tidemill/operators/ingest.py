"""Ingest: which sources are due, which items are new, what is derived from them; and merging changes into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import simhash
from ..functions.urls import canonical_url

MAX_AGE_DAYS, SKEW_HOURS, MOST_BACKOFF, SHORT_BODY = 14, 1, 24, 600


def due(sources: DataFrame, now: Column) -> DataFrame:
    """Enabled sources never fetched, or fetched longer ago than the interval times two to the number of failures, MOST_BACKOFF at most."""
    wait = F.col("fetch_interval_minutes") * 60 * F.least(F.pow(F.lit(2.0), F.col("consecutive_failures")), F.lit(float(MOST_BACKOFF)))
    passed = F.unix_timestamp(now) - F.unix_timestamp("last_fetched_at")
    return sources.filter(F.col("is_enabled") & (F.col("last_fetched_at").isNull() | (passed >= wait)))


def marked(sources: DataFrame, failed: Column, error: Column, now: Column) -> DataFrame:
    """Sources after a fetch: failures count up and keep the error's first 1000 characters, success resets both."""
    return sources.withColumns({
        "consecutive_failures": F.when(failed, F.col("consecutive_failures") + 1).otherwise(0), "last_error": F.when(failed, F.substring(error, 1, 1000)), "last_fetched_at": now,
    })


def dated(items: DataFrame, now: Column) -> DataFrame:
    """Missing times become ``now``, items older than MAX_AGE_DAYS go, times over SKEW_HOURS ahead become ``now``; in this order."""
    given = items.withColumn("published_at", F.coalesce("published_at", now))
    fresh = given.filter(F.col("published_at") >= now - F.make_dt_interval(days=F.lit(MAX_AGE_DAYS)))
    return fresh.withColumn("published_at", F.when(F.col("published_at") > now + F.make_dt_interval(hours=F.lit(SKEW_HOURS)), now).otherwise(F.col("published_at")))


def new_items(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items whose id isn't known for their source and whose canonical URL isn't known at all, the first of each URL and
    of each id by ``position``. ``known``: source_id, external_id, canonical_url."""
    urls = items.withColumn("canonical_url", canonical_url(F.col("url")))
    fresh = urls.join(known.select("source_id", "external_id"), ["source_id", "external_id"], "left_anti").join(known.select("canonical_url").distinct(), "canonical_url", "left_anti")
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("position", "external_id"))
    by_url = fresh.withColumn("_k", first("canonical_url")).filter("_k = 1").drop("_k")
    return by_url.withColumn("_k", first("source_id", "external_id")).filter("_k = 1").drop("_k")


def derived(items: DataFrame) -> DataFrame:
    """Adds content hash, SimHash and cut texts; ``needs_page`` marks bodies too short to stand for the page."""
    body = F.coalesce("content", "excerpt")
    made = lambda n: F.struct(T.content_hash(n).alias("hash"), F.array_join(T.tokenize(n), " ").alias("words"))
    own = items.withColumn("_h", T.let(T.normalize(F.concat_ws(" ", "title", body)), made))
    return own.withColumns({
        "simhash": simhash(F.col("_h.words")), "needs_page": F.length(F.coalesce("content", F.lit(""))) < SHORT_BODY, "content_hash": F.col("_h.hash"),
        "title": T.shorten(F.col("title"), 500, True), "excerpt": T.shorten(F.col("excerpt"), 4000, True), "content": T.shorten(F.col("content"), 50_000, True),
    }).drop("_h")


def report(items: DataFrame, by: str) -> DataFrame:
    return items.groupBy(by).agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("status") == "created").alias("created"), F.count_if(F.col("status") == "failed").alias("failed"))


def saved_and_failed(rows: DataFrame, good: Column) -> DataFrame:
    """(saved, failed): rows for which ``good`` holds, and all others, unknown ones too."""
    return rows.agg(F.count_if(good).alias("saved"), F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"))


def upsert(target: DataFrame, changes: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """``target`` after ``changes``: columns of known rows are updated but for those in ``kept``, which operators own; new
    rows are added."""
    c = changes.select(F.col(key), *[F.col(x).alias(f"_{x}") for x in changes.columns if x != key], F.lit(True).alias("_in"))
    j = target.withColumn("_had", F.lit(True)).join(c, key, "full")
    value = lambda x: F.when(F.col("_had").isNull(), F.col(f"_{x}")).when(F.col("_in"), F.col(x) if x in kept else F.col(f"_{x}")).otherwise(F.col(x)).alias(x)
    return j.select(key, *[value(x) for x in target.columns if x != key])


def replace_from(table: DataFrame, recomputed: DataFrame, column: str, since: Column) -> DataFrame:
    """Rows before ``since`` and the recomputed ones: what was there from ``since`` on goes, also where nothing replaces it."""
    return table.filter(F.col(column) < since).unionByName(recomputed.filter(F.col(column) >= since))


def sync_actions(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What turns ``old`` into ``new``: insert, update, delete or keep for each key."""
    j = old.withColumnRenamed(value, "_old").withColumn("_o", F.lit(True)).join(new.withColumnRenamed(value, "_new").withColumn("_n", F.lit(True)), keys, "full")
    action = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update")
    return j.select(*keys, action.alias("action"), F.coalesce("_new", "_old").alias(value))


def replace_explicit(interests: DataFrame, chosen: DataFrame) -> DataFrame:
    """Readers' explicit interests become the chosen ones; inferred ones stay, and a chosen one that was there becomes
    explicit with weight 1.0 at least."""
    j = interests.join(chosen.withColumn("_c", F.lit(True)), ["user_id", "topic_id"], "full")
    kept = j.filter(F.col("_c") | ~F.col("is_explicit"))
    return kept.select("user_id", "topic_id", F.when(F.col("_c"), F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1.0))).otherwise(F.col("weight")).alias("weight"), F.coalesce(F.col("_c"), F.col("is_explicit")).alias("is_explicit"))


def toggled(log: DataFrame, keys: list[str]) -> DataFrame:
    """Keys toggled an odd number of times: those that are on."""
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") % 2 == 1).select(*keys)


def search_documents(stories: DataFrame, story_topics: DataFrame) -> DataFrame:
    """Rows for a search index: topics as an array, times as Unix seconds."""
    slugs = story_topics.groupBy("story_id").agg(F.array_sort(F.collect_set("topic_id")).alias("topics"))
    return stories.join(slugs, "story_id", "left").select("story_id", "category", F.unix_seconds(F.col("published_at").cast("timestamp")).alias("published_unix"), F.coalesce("topics", F.array().cast("array<long>")).alias("topics"))
