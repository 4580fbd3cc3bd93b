"""Queries that run as streams over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from ..sources import tables as T
from ..sources.storage import new_path
from ..sources.tables import at
from ..streaming import backoff
from ..streaming import cycle as C
from ..streaming import pipeline as P
from .registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@R.add("SELECT event_type AS topic, CAST(date_trunc('week', ts) AS TIMESTAMP) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def stream_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "stream-trends")
    P.run(P.trend_windows(_events(spark, sf_dir), "ts", "event_type"), P.upsert_counts(path, ["topic", "window_start"]), "update", path)
    return P.last_of(spark, path, ["topic", "window_start"]).select("topic", "window_start", "n")


@R.add("SELECT user_id AS topic, date_trunc('minute', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a reader and minute."""
    path = new_path(spark, "stream-rates")
    P.run(P.trend_windows(_events(spark, sf_dir), "ts", "user_id", "1 minute", "0 seconds"), P.upsert_counts(path, ["topic", "window_start"]), "update", path)
    return P.last_of(spark, path, ["topic", "window_start"]).select("topic", "window_start", "n")


@R.add("SELECT event_id % 5000 AS external_id FROM events GROUP BY ALL")
def stream_new_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select((F.col("event_id") % 5000).alias("external_id"), "ts")
    return spark.read.parquet(P.run(P.new_articles(e, "ts", "external_id"))).select("external_id")


@R.add("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), r AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS run FROM d), g AS (SELECT user_id, run, CAST(count(*) AS INTEGER) AS n, max(d) AS last FROM r GROUP BY ALL)
SELECT user_id, arg_max(n, last) AS current, max(n) AS longest, CAST(max(last) - DATE '1970-01-01' AS INTEGER) AS last_day FROM g GROUP BY user_id""")
def stream_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "stream-streaks")
    P.run(P.streaks(_events(spark, sf_dir)), P.upsert_counts(path, ["user_id"]), "update", path)
    return P.last_of(spark, path, ["user_id"]).select("user_id", "current", "longest", "last_day")


#: Runs of the cycle, and the moment at which they are asked.
_RUNS, _CYCLE_NOW = 3, "2024-01-08 00:00:00"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fetched items: some repeat an id, and some have no address, no text, or a time that is old or no time."""
    i = F.col("doc_id")
    published = F.when(i % 17 == 0, "soon").when(i % 13 == 0, "2023-11-05 10:00:00").otherwise(F.date_format(F.timestamp_seconds(F.unix_timestamp(at("2024-01-01 00:00:00")) + i % 10000 * 60), "yyyy-MM-dd HH:mm:ss"))
    d = T.table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("source_id"), F.when(i % 10 == 3, i - 1).otherwise(i).alias("external_id"), i.alias("position"), F.when(i % 19 > 0, F.concat(F.lit("http://www.e.org/a/"), i.cast("string"), F.lit("/?utm_source=x"))).alias("url"),
        F.concat(F.lit("t"), i.cast("string")).alias("title"), F.lit(None).cast("string").alias("excerpt"), F.when(i % 23 > 0, F.substring_index("text", "\n", 3)).alias("content"), published.alias("published"),
    )


def _cycled(spark: SparkSession, sf_dir: str) -> C.Cycle:
    """Each run of the stream finds what has come since the last one."""
    path = new_path(spark, "cycle")
    cycle = C.Cycle(spark, f"{path}/tables", at(_CYCLE_NOW))
    for k in range(_RUNS):
        _items(spark, sf_dir).filter(F.col("position") % _RUNS == k).write.mode("append").parquet(f"{path}/feed")
        P.run(P.read(spark, f"{path}/feed"), cycle.step, path=f"{path}/stream")
    return cycle


_LABELLED = f"""i AS (SELECT doc_id % {_RUNS} AS batch, source, CASE WHEN doc_id % 10 = 3 THEN doc_id - 1 ELSE doc_id END AS external_id, doc_id AS position,
    CASE WHEN doc_id % 19 = 0 THEN 'no address' WHEN doc_id % 23 = 0 OR trim(regexp_replace(array_to_string(string_split(text, chr(10))[1:3], chr(10)), '^ +| +$', '', 'g')) = '' THEN 'no text' WHEN doc_id % 17 = 0 THEN 'unreadable time' WHEN doc_id % 13 = 0 THEN 'too old' END AS reason FROM documents),
l AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN row_number() OVER (PARTITION BY source, external_id, reason IS NULL ORDER BY batch, position) = 1 THEN 'created' ELSE 'known' END AS status FROM i)"""


@R.add(f"WITH {_LABELLED} SELECT CAST(batch AS INTEGER) AS batch, count(*) AS fetched, count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'known') AS known, count(*) FILTER (status = 'rejected') AS rejected FROM l GROUP BY ALL")
def cycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the items of each run."""
    return _cycled(spark, sf_dir).counts().select("batch", "fetched", *C.STATUSES)


@R.add(f"WITH {_LABELLED} SELECT position, reason FROM l WHERE status = 'rejected'")
def cycle_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cycled(spark, sf_dir).items("rejected").select("position", "reason")


@R.add("""WITH e AS (SELECT user_id AS source_id, ts, event_id AS seq, CAST(event_type IN ('view', 'click') AS INTEGER) AS failed FROM events), g AS (SELECT *, sum(1 - failed) OVER (PARTITION BY source_id ORDER BY ts, seq) AS run FROM e),
f AS (SELECT *, CAST(sum(failed) OVER (PARTITION BY source_id, run ORDER BY ts, seq) AS BIGINT) AS failures FROM g), d AS (SELECT *, ts + INTERVAL 30 MINUTE * least(CAST(pow(2, failures) AS BIGINT), 24) AS due_at, lead(ts) OVER (PARTITION BY source_id ORDER BY ts, seq) AS following, max(ts) OVER () AS ended FROM f)
SELECT source_id, due_at, failures FROM d WHERE due_at <= COALESCE(following, ended)""")
def source_due_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetches of a source every half hour, some of which fail: when each became due before it was fetched again."""
    e = P.read(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("source_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").isin("view", "click").alias("failed"), F.lit(30).alias("minutes"))
    with backoff.timers(spark):
        return spark.read.parquet(P.run(backoff.due_moments(e)))


@R.add("SELECT 'day' AS period, CAST(ts AS DATE) AS period_start, event_type AS topic, count(*) AS n FROM events GROUP BY ALL")
def stored_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of daily counts: a first run over the first half of the days, with rows of a day that has none in truth, and
    one that computes the later days and that day again."""
    path = new_path(spark, "trends")
    e = T.table(spark, sf_dir, "events").select(F.lit("day").alias("period"), F.to_date("ts").alias("period_start"), F.col("event_type").alias("topic"))
    counts = e.groupBy("period", "period_start", "topic").agg(F.count(F.lit(1)).alias("n"))
    wrong = counts.filter("period_start = DATE '2024-01-03'").withColumn("period_start", F.lit("2023-12-31").cast("date"))
    early, stale = F.col("period_start") <= F.lit("2024-01-15").cast("date"), F.col("period_start") == F.lit("2023-12-31").cast("date")
    first = counts.filter(early).unionByName(wrong)
    sinks.replace_periods(first, path, ["period", "period_start"], first)
    again = counts.filter(~early).select("period", "period_start").unionByName(first.filter(stale).select("period", "period_start"))
    sinks.replace_periods(counts, path, ["period", "period_start"], again)
    return spark.read.schema("topic string, n long, period string, period_start date").parquet(path).select("period", "period_start", "topic", "n")
