"""The cycle of ingest, clustering and enrichment as one stream.

Each micro-batch of items goes through all steps, and what a step adds to a table is written under the batch's number. A
batch that was stopped between two steps comes again with its number; it replaces its own rows and reads those of smaller
numbers only, so every table is as after an undisturbed run. Items that can't be used aren't lost: they are kept with
their reason, and what became of the batch's items is counted while they are written, not by another scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url
from ..operators import ingest
from ..operators.story_store import StoryStore, cluster_batch

STATUSES = ("created", "known", "rejected")
ITEM = "source_id string, external_id long, position long, url string, title string, excerpt string, content string, published string"
_ITEMS = ITEM + ", published_at timestamp, canonical_url string, reason string, content_hash string, simhash long, needs_page boolean, article_id long, status string, batch int"
_ENRICHED = "story_id long, headline string, articles long, sources long, last_activity_at timestamp, batch int"
_COUNTS = "fetched long, created long, known long, rejected long, batch int"


def reason(now: Column) -> Column:
    """Why an item can't be used; null if it can. ``published`` may be missing, which stands for now, but not be unreadable."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    at = F.try_to_timestamp("published")
    checks = ((blank("url"), "no address"), (blank("title"), "no title"), (blank("content") & blank("excerpt"), "no text"), (~blank("published") & at.isNull(), "unreadable time"), (at < now - F.make_dt_interval(days=F.lit(ingest.MAX_AGE_DAYS)), "too old"))
    return F.coalesce(*(F.when(bad, F.lit(name)) for bad, name in checks))


def labelled(items: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """Items with ``published_at``, ``canonical_url``, ``reason`` and ``status``: rejected if there is a reason; known if the
    source's id or the address is in ``known`` (source_id, external_id, canonical_url) or an earlier item has it; else created."""
    at = F.coalesce(F.try_to_timestamp("published"), now)
    ahead = at > now + F.make_dt_interval(hours=F.lit(ingest.SKEW_HOURS))
    read = items.withColumns({"reason": reason(now), "published_at": F.when(ahead, now).otherwise(at), "canonical_url": canonical_url(F.col("url"))})
    ids = known.select("source_id", "external_id").distinct().withColumn("_id", F.lit(True))
    urls = known.select("canonical_url").distinct().withColumn("_url", F.lit(True))
    met = read.join(ids, ["source_id", "external_id"], "left").join(urls, "canonical_url", "left")
    met = met.withColumn("_new", F.col("reason").isNull() & F.col("_id").isNull() & F.col("_url").isNull())
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("position", "external_id")) == 1
    met = met.withColumn("_new", F.col("_new") & first("canonical_url", "_new"))
    met = met.withColumn("_new", F.col("_new") & first("source_id", "external_id", "_new"))
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("_new"), "created").otherwise("known")
    return met.withColumn("status", status).drop("_id", "_url", "_new")


class Cycle:
    """Tables at ``path``: items (by status), counts, enriched stories, and the store of stories. ``after`` is called with the
    name of each step that is done and the batch's number."""

    def __init__(self, spark: SparkSession, path: str, now: Column, after: Callable[[str, int], None] = lambda step, batch: None) -> None:
        self.spark, self.path, self.now, self.after = spark, path, now, after
        self.store = StoryStore(spark, f"{path}/stories")

    def read(self, name: str, schema: str, below: int | None = None) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if below is None else rows.filter(F.col("batch") < below)

    def items(self, status: str, below: int | None = None) -> DataFrame:
        """Items of a status; those that are rejected carry a reason."""
        return self.read("items", _ITEMS, below).filter(F.col("status") == status)

    def counts(self) -> DataFrame:
        return self.read("counts", _COUNTS)

    def enriched(self) -> DataFrame:
        """The last state of each story."""
        rows = self.read("enriched", _ENRICHED)
        return rows.groupBy("story_id").agg(F.max_by(F.struct("headline", "articles", "sources", "last_activity_at"), "batch").alias("x")).select("story_id", "x.*")

    def step(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of items (ITEM), through all steps."""
        self._ingest(batch, number)
        self.after("ingest", number)
        fresh = self.items("created").filter(F.col("batch") == number)
        made = cluster_batch(self.store, fresh.withColumn("embedding", F.lit(None).cast("array<float>")), number)
        self.after("cluster", number)
        self._enrich(made, number)
        self.after("enrich", number)

    def _ingest(self, batch: DataFrame, number: int) -> None:
        known = self.items("created", number).select("source_id", "external_id", "canonical_url")
        rows = ingest.derived(labelled(batch, known, self.now)).withColumn("article_id", F.xxhash64("source_id", "external_id"))
        seen = Observation()
        watched = rows.observe(seen, F.count(F.lit(1)).alias("fetched"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
        watched.write.mode("overwrite").partitionBy("status").parquet(f"{self.path}/items/batch={number}")
        row = tuple(seen.get[c] for c in ("fetched", *STATUSES))
        self.spark.createDataFrame([row], _COUNTS.removesuffix(", batch int")).write.mode("overwrite").parquet(f"{self.path}/counts/batch={number}")

    def _enrich(self, made: DataFrame, number: int) -> None:
        """Stories that the batch touched, from all their articles so far."""
        placed = self.store.read("assigned", number + 1).select("article_id", "story_id").join(made.select("story_id").distinct(), "story_id", "left_semi")
        own = placed.join(self.items("created", number + 1).select("article_id", "title", "source_id", "published_at"), "article_id")
        first = F.min(F.struct("published_at", "article_id", "title"))["title"]
        rows = own.groupBy("story_id").agg(first.alias("headline"), F.count(F.lit(1)).alias("articles"), F.count_distinct("source_id").alias("sources"), F.max("published_at").alias("last_activity_at"))
        rows.write.mode("overwrite").parquet(f"{self.path}/enriched/batch={number}")
