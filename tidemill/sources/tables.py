"""Typed views of the base tables as the engine's entities.

The test tables have no articles, stories or readers, so these views derive them: orders with their line items are
stories told by several sources (suppliers), parts give topics, events are readers' interactions, documents are articles.
Each view reads only the columns it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which queries over stories and over events are asked.
STORY_NOW, EVENT_NOW = "2001-08-02 00:00:00", "2024-01-31 00:00:00"
TOPICS = 43
CATEGORIES = ("Ai", "Software", "OpenSource", "Security", "Tools", "Startup", "Career", "Science", "Hardware", "Product")
_ARTICLES_FROM = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, name, is_official, trust_weight."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), (F.col("s_acctbal") >= 5000).alias("is_official"), F.round((F.col("s_acctbal") + 1000) / 11000, 4).alias("trust_weight"))


def story_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of stories: story_id, position, source_id, published_at, engagement_score, topic_id, weight."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        F.col("l_orderkey").alias("story_id"), F.col("l_linenumber").alias("position"), F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").cast("timestamp").alias("published_at"),
        F.col("l_quantity").cast("int").alias("engagement_score"), (F.col("l_partkey") % TOPICS).alias("topic_id"), (F.col("l_discount") * 10).alias("weight"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """story_id, topic, published_at, status, category and importance of each story, without what its members add."""
    o = table(spark, sf_dir, "orders")
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("o_orderkey") % len(CATEGORIES) + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "P", "Draft").otherwise("Published")
    return o.select(F.col("o_orderkey").alias("story_id"), F.col("o_orderpriority").alias("topic"), F.col("o_orderdate").cast("timestamp").alias("published_at"), status.alias("status"), category.alias("category"), F.floor(F.col("o_totalprice") % 101).cast("int").alias("importance"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, story_id, kind and occurred_at; event n is about story n."""
    kind = F.when(F.col("event_type") == "view", "Open").when(F.col("event_type") == "click", "ReadComplete").when(F.col("event_type") == "purchase", "Bookmark").when(F.col("event_type") == "signup", "Impression").otherwise("Mute")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("story_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("occurred_at"), F.col("value"))


def interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, topic_id, weight: the strongest bookmark of each topic."""
    i = interactions(spark, sf_dir).filter("kind = 'Bookmark'")
    return i.groupBy("user_id", (F.col("story_id") % TOPICS).alias("topic_id")).agg(F.max(F.least(F.col("value") / 20, F.lit(1.0))).alias("weight"))


def muted(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = interactions(spark, sf_dir).filter("kind = 'Mute'")
    return i.select("user_id", (F.col("story_id") % TOPICS).alias("topic_id")).distinct()


def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = interactions(spark, sf_dir).filter("kind = 'Impression'")
    return i.select("user_id", (F.col("story_id") % 10).alias("source_id")).distinct()


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, source, title (first line), content, published_at (one a minute)."""
    d = table(spark, sf_dir, "documents")
    published = F.timestamp_seconds(F.unix_timestamp(at(_ARTICLES_FROM)) + F.col("doc_id") * 60)
    return d.select(F.col("doc_id").alias("article_id"), "source", "lang", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), published.alias("published_at"), F.col("n_chars").alias("n_chars"))


SQL = {
    "sources": "sources AS (SELECT s_suppkey AS source_id, s_name AS name, s_acctbal >= 5000 AS is_official, round((s_acctbal + 1000) / 11000, 4) AS trust_weight FROM supplier)",
    "story_members": f"story_members AS (SELECT l_orderkey AS story_id, l_linenumber AS position, l_suppkey AS source_id, l_shipdate AS published_at, CAST(trunc(l_quantity) AS INTEGER) AS engagement_score, l_partkey % {TOPICS} AS topic_id, l_discount * 10 AS weight FROM lineitem)",
    "stories": f"stories AS (SELECT o_orderkey AS story_id, o_orderpriority AS topic, o_orderdate AS published_at, CASE WHEN o_orderstatus = 'P' THEN 'Draft' ELSE 'Published' END AS status, [{', '.join(repr(c) for c in CATEGORIES)}][o_orderkey % {len(CATEGORIES)} + 1] AS category, CAST(floor(o_totalprice % 101) AS INTEGER) AS importance FROM orders)",
    "interactions": "interactions AS (SELECT user_id, event_id AS story_id, CASE event_type WHEN 'view' THEN 'Open' WHEN 'click' THEN 'ReadComplete' WHEN 'purchase' THEN 'Bookmark' WHEN 'signup' THEN 'Impression' ELSE 'Mute' END AS kind, ts AS occurred_at, value FROM events)",
    "interests": f"interests AS (SELECT user_id, story_id % {TOPICS} AS topic_id, max(least(value / 20, 1.0)) AS weight FROM interactions WHERE kind = 'Bookmark' GROUP BY ALL)",
    "muted": f"muted AS (SELECT DISTINCT user_id, story_id % {TOPICS} AS topic_id FROM interactions WHERE kind = 'Mute')",
    "favourites": "favourites AS (SELECT DISTINCT user_id, story_id % 10 AS source_id FROM interactions WHERE kind = 'Impression')",
    "articles": f"articles AS (SELECT doc_id AS article_id, source, lang, split_part(text, chr(10), 1) AS title, text AS content, TIMESTAMP '{_ARTICLES_FROM}' + doc_id * INTERVAL 1 MINUTE AS published_at, n_chars FROM documents)",
}


def sql_with(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
