"""Queries over stories: trends, scores, editions, feeds, readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import readers, scoring, stories, trends
from ..sources import tables as T
from ..sources.storage import stored
from ..sources.tables import EVENT_NOW, STORY_NOW, at, sql_with
from .registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql
POOL = 250

_AGG = """agg AS (SELECT story_id, CAST(count(DISTINCT source_id) AS INTEGER) AS distinct_source_count, CAST(count(DISTINCT CASE WHEN is_official THEN source_id END) AS INTEGER) AS official_source_count,
    COALESCE(max(trust_weight), 0.5) AS max_trust_weight, CAST(sum(COALESCE(engagement_score, 0)) AS BIGINT) AS engagement, min(published_at) AS first_published_at, max(published_at) AS last_activity_at
    FROM story_members LEFT JOIN sources USING (source_id) GROUP BY story_id)"""
_COUNTED = "counted AS (SELECT stories.*, distinct_source_count, official_source_count, max_trust_weight, engagement FROM stories JOIN agg USING (story_id))"
_HOURS = f"(epoch_us(TIMESTAMP '{STORY_NOW}') - epoch_us(published_at)) / 3.6e9"
_WHOLE = "CAST(round_even(least(greatest({}, 0.0), 100.0), 0) AS INTEGER)"
_PARTS = f"""parts AS (SELECT *, CASE WHEN official_source_count <= 0 THEN {_WHOLE.format('least(greatest(max_trust_weight, 0.0), 1.0) * 60')} ELSE {_WHOLE.format('70.0 + least(30, (official_source_count - 1) * 10)')} END AS official,
    CASE WHEN distinct_source_count <= 0 THEN 0 ELSE {_WHOLE.format('least(1.0, log2(1.0 + distinct_source_count) / log2(9.0)) * 100')} END AS corroboration,
    CASE WHEN {_HOURS} <= 6 THEN 100 ELSE {_WHOLE.format(f'greatest(20.0, 100 * pow(0.5::DOUBLE, {_HOURS} / 72))')} END AS recency, {_WHOLE.format('COALESCE(CASE WHEN story_id % 4 > 0 THEN importance / 100 END, 0.6::DOUBLE) * 100')} AS technical,
    CASE WHEN engagement <= 0 THEN 35 ELSE {_WHOLE.format('least(1.0, log10(1.0 + engagement) / log10(1001.0)) * 100')} END AS community FROM counted)"""
_TOTAL = f"trusted AS (SELECT *, {_WHOLE.format('0.30::DOUBLE * official + 0.25::DOUBLE * corroboration + 0.20::DOUBLE * technical + 0.15::DOUBLE * community + 0.10::DOUBLE * recency')} AS trust_score FROM parts)"
_FACTOR = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in scoring.MULTIPLIER.items()) + f" ELSE {scoring.OTHER_MULTIPLIER}::DOUBLE END"
_IMPORTANCE = f"""scored AS (SELECT *, {_WHOLE.format(f'''(35::DOUBLE * CASE WHEN story_id % 5 > 0 THEN least(greatest(0.3::DOUBLE + 0.1::DOUBLE * distinct_source_count, 0.3), 0.8) ELSE 0.5::DOUBLE END + 0.20::DOUBLE * (least(1.0, log2(1.0 + distinct_source_count + official_source_count) / log2(11.0)) * 100) + 15.0::DOUBLE * pow(0.5::DOUBLE, greatest(0.0, {_HOURS}) / 24)
    + 0.15::DOUBLE * trust_score + 0.15::DOUBLE * CASE WHEN engagement <= 0 THEN 25.0 ELSE least(1.0, log10(1.0 + engagement) / log10(1501.0)) * 100 END) * {_FACTOR}''')} AS importance_score FROM trusted)"""
SCORED = ",\n".join([sql_with("sources", "story_members", "stories"), _AGG, _COUNTED, _PARTS, _TOTAL, _IMPORTANCE])
_PRIMARY = "primaries AS (SELECT story_id, source_id AS primary_source_id, position FROM story_members LEFT JOIN sources USING (source_id) QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY NOT COALESCE(is_official, false), published_at, position, source_id) = 1)"
_TOPICS = "story_topics AS (SELECT story_id, topic_id, max(weight) AS weight FROM story_members GROUP BY ALL)"


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = stories.aggregates(T.story_members(spark, sf_dir), T.sources(spark, sf_dir)).drop("first_published_at", "last_activity_at")
    known = T.stories(spark, sf_dir).withColumn("technical_accuracy", F.when(F.col("story_id") % 4 > 0, F.col("importance") / 100))
    return known.join(agg, "story_id").withColumn("estimated_importance", F.when(F.col("story_id") % 5 > 0, text.importance_estimate(F.col("distinct_source_count"))))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = at(STORY_NOW)
    return scoring.importance(scoring.trust(counted(spark, sf_dir), now), now)


def _trend(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    n = T.story_members(spark, sf_dir).groupBy("story_id").agg(F.count_distinct("source_id").alias("source_count"))
    return trends.buckets(T.stories(spark, sf_dir).join(n, "story_id"), period)


def _trend_sql(period: str, previous: str) -> str:
    return f"""{sql_with("story_members", "stories")},
n AS (SELECT story_id, count(DISTINCT source_id) AS source_count FROM story_members GROUP BY ALL),
t AS (SELECT topic, CAST(date_trunc('{period}', published_at) AS DATE) AS period_start, count(*) AS story_count, CAST(sum(source_count) AS BIGINT) AS source_count, CAST(sum(importance) AS BIGINT) AS weighted_importance
    FROM stories JOIN n USING (story_id) GROUP BY ALL)
SELECT t.*, CASE WHEN COALESCE(p.story_count, 0) = 0 THEN 100.0 ELSE round_even((t.story_count - p.story_count) / p.story_count * 100, 2) END AS momentum_percent
FROM t LEFT JOIN t p ON p.topic = t.topic AND p.period_start = t.period_start - INTERVAL {previous}"""


@R.add(_trend_sql("month", "1 MONTH"))
def trends_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.momentum(_trend(spark, sf_dir, "month"), "month")


@R.add(_trend_sql("week", "7 DAY"))
def trends_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.momentum(_trend(spark, sf_dir, "week"), "week")


@R.add(_trend_sql("day", "7 DAY"))
def trends_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are compared with the day a week before."""
    return trends.momentum(_trend(spark, sf_dir, "day"), "day")


@R.add(f"SELECT * REPLACE (CASE WHEN period_start = CAST(date_trunc('month', TIMESTAMP '{STORY_NOW}') AS DATE) THEN momentum_percent ELSE 0.0 END AS momentum_percent) FROM ({_trend_sql('month', '1 MONTH')})")
def trends_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.current(_trend(spark, sf_dir, "month"), "month", at(STORY_NOW))


@R.add(f"SELECT topic, list({{'period_start': period_start, 'story_count': story_count}} ORDER BY period_start) AS history FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY period_start DESC) AS k FROM ({_trend_sql('month', '1 MONTH')})) WHERE k <= 6 GROUP BY topic")
def trend_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.history(_trend(spark, sf_dir, "month"))


@R.add(f"SELECT topic, period_start, greatest(4.0, story_count / max(story_count) OVER () * 100) AS width FROM ({_trend_sql('month', '1 MONTH')})")
def trend_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.bar_width(_trend(spark, sf_dir, "month")).select("topic", "period_start", "width")


@R.add(f"{sql_with('sources', 'story_members')},\n{_AGG}\nSELECT * FROM agg")
def story_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.aggregates(T.story_members(spark, sf_dir), T.sources(spark, sf_dir))


@R.add(f"""{SCORED}
SELECT story_id, official, corroboration, recency, technical, community, trust_score,
    CASE WHEN trust_score >= 85 THEN 'Çok güvenilir' WHEN trust_score >= 70 THEN 'Güvenilir' WHEN trust_score >= 50 THEN 'Makul' WHEN trust_score >= 30 THEN 'Temkinli yaklaş' ELSE 'Doğrulanmamış' END || ' — '
    || CASE WHEN official_source_count > 0 THEN official_source_count || ' resmi kaynak, ' ELSE '' END || CASE WHEN distinct_source_count > 1 THEN distinct_source_count || ' kaynak doğruladı' ELSE 'tek kaynak' END || ', '
    || CASE WHEN {_HOURS} <= 24 THEN 'son 24 saat' ELSE CAST(trunc({_HOURS} / 24) AS BIGINT) || ' gün önce' END || '.' AS trust_reason
FROM scored""")
def trust_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.trust(counted(spark, sf_dir), at(STORY_NOW)).select("story_id", "official", "corroboration", "recency", "technical", "community", "trust_score", "trust_reason")


@R.add(f"{SCORED}\nSELECT story_id, category, trust_score, importance_score FROM scored")
def importance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("story_id", "category", "trust_score", "importance_score")


@R.add(f"{sql_with('sources', 'story_members')},\n{_PRIMARY}\nSELECT * FROM primaries")
def primary_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.primary(T.story_members(spark, sf_dir), T.sources(spark, sf_dir))


_PERSONAL = f"""{SCORED},\n{_PRIMARY},\n{_TOPICS},\n{", ".join(T.SQL[k] for k in ("interactions", "interests", "muted", "favourites"))},
pool AS (SELECT story_id, category, importance_score, trust_score, primary_source_id, CAST(engagement % 9 + 1 AS INTEGER) AS reading_minutes FROM scored JOIN primaries USING (story_id) WHERE status = 'Published' ORDER BY importance_score DESC, published_at DESC, story_id LIMIT {POOL}),
readers AS (SELECT DISTINCT user_id FROM interactions),
liked AS (SELECT user_id, story_id, max(least(greatest(i.weight, 0.0), 1.0) * least(greatest(t.weight, 0.0), 1.0)) AS best, count(*) AS matches FROM interests i JOIN story_topics t USING (topic_id) JOIN pool USING (story_id) GROUP BY ALL),
unwanted AS (SELECT DISTINCT user_id, story_id FROM muted JOIN story_topics USING (topic_id) JOIN pool USING (story_id)),
known AS (SELECT DISTINCT user_id, story_id FROM interactions WHERE kind <> 'Impression'),
opens AS (SELECT DISTINCT user_id, story_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, story_id DESC) AS k FROM interactions WHERE kind IN ('Open', 'ReadComplete')) WHERE k <= 40),
means AS (SELECT user_id, i, CAST(avg(CAST(x AS DOUBLE)) AS FLOAT) AS m FROM (SELECT user_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM opens JOIN embeddings ON vec_id = story_id) GROUP BY ALL),
tastes AS (SELECT user_id, CAST(list(m ORDER BY i) AS DOUBLE[]) AS taste FROM means GROUP BY user_id),
j AS (SELECT r.user_id, p.*, CASE WHEN matches IS NULL THEN 0.0 ELSE least(1.0, best + least(0.2::DOUBLE, (matches - 1) * 0.07::DOUBLE)) * 100 END AS interest, f.user_id IS NOT NULL AS favourite, k.user_id IS NOT NULL AS seen, CASE WHEN taste IS NOT NULL AND e.embedding IS NOT NULL THEN greatest(COALESCE(list_cosine_similarity(taste, CAST(e.embedding AS DOUBLE[])), 0.0), 0.0) ELSE 0.0 END AS similarity
    FROM readers r CROSS JOIN pool p LEFT JOIN liked l ON l.user_id = r.user_id AND l.story_id = p.story_id LEFT JOIN favourites f ON f.user_id = r.user_id AND f.source_id = p.primary_source_id
    LEFT JOIN known k ON k.user_id = r.user_id AND k.story_id = p.story_id LEFT JOIN tastes ON tastes.user_id = r.user_id LEFT JOIN embeddings e ON e.vec_id = p.story_id % 500 WHERE NOT EXISTS (FROM unwanted u WHERE u.user_id = r.user_id AND u.story_id = p.story_id)),
personal AS (SELECT user_id, story_id, category, reading_minutes, round_even(least(greatest((0.45::DOUBLE * importance_score + 0.35::DOUBLE * interest + 0.12::DOUBLE * similarity * 100 + 0.08::DOUBLE * CASE WHEN favourite THEN 100.0 ELSE 0.0 END) * CASE WHEN seen THEN 0.25::DOUBLE ELSE 1 END, 0.0), 100.0), 4) AS score,
    CASE WHEN interest >= 60 THEN 'İlgi alanlarınla doğrudan ilgili.' WHEN favourite THEN 'Takip ettiğin kaynaktan.' WHEN importance_score >= 85 THEN 'Bugünün en büyük gelişmelerinden.' WHEN trust_score >= 85 THEN 'Birden fazla resmi kaynak doğruladı.' WHEN interest > 0 THEN 'İlgi alanlarınla kısmen örtüşüyor.' ELSE 'Alanında öne çıkan gelişme.' END AS reason FROM j)"""


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool is found first; then its stories alone meet their members, each of which has a primary one."""
    members, i = T.story_members(spark, sf_dir), T.interactions(spark, sf_dir)
    best = scored(spark, sf_dir).filter("status = 'Published'").orderBy(F.desc("importance_score"), F.desc("published_at"), "story_id").limit(POOL)
    best = stored(best.select("story_id", "category", "importance_score", "trust_score", (F.col("engagement") % 9 + 1).cast("int").alias("reading_minutes")), "pool")
    members = members.join(F.broadcast(best.select("story_id")), "story_id", "left_semi")
    e = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("story_id"), "embedding")
    pool = best.join(stories.primary(members, T.sources(spark, sf_dir)).drop("position"), "story_id")
    pool = pool.withColumn("_v", F.col("story_id") % 500).join(e.withColumnRenamed("story_id", "_v"), "_v", "left").drop("_v")
    return scoring.personal(stored(pool, "pool"), i.select("user_id").distinct(), stories.topics(members), T.interests(spark, sf_dir), T.muted(spark, sf_dir), T.favourites(spark, sf_dir), readers.seen(i), readers.taste(i, e))


@R.add(f"{_PERSONAL}\nSELECT user_id, story_id, score, reason FROM personal")
def personal_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).select("user_id", "story_id", "score", "reason")


_COMPOSED = f"""{_PERSONAL},
capped AS (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY score DESC, story_id) > {scoring.CATEGORY_CAP} AS over FROM personal),
edition AS (SELECT user_id, story_id, category, reading_minutes, score, reason, CAST(row_number() OVER (PARTITION BY user_id ORDER BY over, score DESC, story_id) AS INTEGER) AS rank FROM capped QUALIFY rank <= {scoring.TAKE['week']})"""


@R.add(f"{_COMPOSED}\nSELECT user_id, rank, story_id, category, score, reason FROM edition")
def weekly_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.compose(_personal(spark, sf_dir), scoring.TAKE["week"]).select("user_id", "rank", "story_id", "category", "score", "reason")


@R.add(f"{_COMPOSED}\nSELECT user_id, count(*) AS n, CAST(greatest(1, sum(greatest(1, reading_minutes))) AS BIGINT) AS reading_minutes, CASE count(*) WHEN 1 THEN 'Bugün tek bir gelişme öne çıkıyor.' ELSE 'Bugün için ' || count(*) || ' gelişme seçildi.' END AS intro FROM edition GROUP BY user_id")
def edition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scoring.compose(_personal(spark, sf_dir), scoring.TAKE["week"])
    minutes = F.greatest(F.lit(1), F.sum(F.greatest(F.lit(1), "reading_minutes"))).cast("long")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), minutes.alias("reading_minutes")).withColumn("intro", text.digest_intro(F.col("n")))


_DAY = "CAST(occurred_at + INTERVAL 3 HOUR AS DATE)"


@R.add(f"""{sql_with('interactions')},
d AS (SELECT DISTINCT user_id, {_DAY} AS d FROM interactions), r AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS run FROM d),
g AS (SELECT user_id, run, CAST(count(*) AS INTEGER) AS n, max(d) AS last FROM r GROUP BY ALL)
SELECT user_id, arg_max(n, last) AS current, max(n) AS longest, max(last) AS last_active_date FROM g GROUP BY user_id""")
def reader_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = dates.local(F.col("occurred_at"), F.lit("Europe/Istanbul"), ["Europe/Istanbul", "UTC"])
    return readers.streaks(T.interactions(spark, sf_dir), F.to_date(zone))


@R.add(f"{sql_with('interactions')}\nSELECT DISTINCT user_id, story_id FROM interactions WHERE kind <> 'Impression'")
def seen_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.seen(T.interactions(spark, sf_dir))


_OPENS = f"{sql_with('interactions')},\nopens AS (SELECT DISTINCT user_id, story_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, story_id DESC) AS k FROM interactions WHERE kind IN ('Open', 'ReadComplete')) WHERE k <= 40)"


@R.add(f"{_OPENS}\nSELECT * FROM opens")
def latest_opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.latest_opens(T.interactions(spark, sf_dir))


@R.add(f"""{_OPENS},
l AS (SELECT user_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM opens JOIN embeddings ON vec_id = story_id),
m AS (SELECT user_id, i, avg(CAST(x AS DOUBLE)) AS m FROM l GROUP BY ALL)
SELECT user_id, round(sum(m), 5) AS total, count(*) AS width FROM m GROUP BY user_id""")
def reader_taste(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("story_id"), "embedding")
    taste = readers.taste(T.interactions(spark, sf_dir), e)
    total = F.aggregate("taste", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return taste.select("user_id", F.round(total, 5).alias("total"), F.size("taste").cast("long").alias("width"))


@R.add(f"{SCORED}\nSELECT story_id, category, importance_score, published_at FROM scored WHERE status = 'Published' AND category = 'Ai' AND published_at >= TIMESTAMP '{STORY_NOW}' - INTERVAL 8760 HOUR ORDER BY importance_score DESC, published_at DESC, story_id LIMIT 20 OFFSET 20")
def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stories.feed(scored(spark, sf_dir), "Ai", 8760, at(STORY_NOW))
    return stories.page(f, [F.desc("importance_score"), F.desc("published_at"), F.col("story_id")], 2, 20, 50).select("story_id", "category", "importance_score", "published_at")


@R.add(f"{sql_with('stories')}\nSELECT count(*) AS total_count, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages, ceil(count(*) / 20.0) > 2 AS has_next FROM stories WHERE status = 'Published' AND category = 'Ai'")
def feed_page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.page_info(stories.feed(T.stories(spark, sf_dir), "Ai"), 2, 20)


@R.add(f"""{SCORED}, c AS (SELECT *, 1 AS k, row_number() OVER (ORDER BY importance_score DESC, trust_score DESC, story_id) AS o FROM scored WHERE status = 'Published' AND published_at >= TIMESTAMP '{STORY_NOW}' - INTERVAL 36 HOUR
    UNION ALL SELECT *, 2, row_number() OVER (ORDER BY published_at DESC, story_id) FROM scored WHERE status = 'Published')
SELECT story_id, importance_score, trust_score FROM c ORDER BY k, o LIMIT 1""")
def top_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = at(STORY_NOW) - F.make_dt_interval(hours=F.lit(36))
    return stories.top_story(scored(spark, sf_dir), since).select("story_id", "importance_score", "trust_score")


@R.add(f"""{sql_with('story_members', 'stories')},\n{_TOPICS},
s AS (SELECT story_id, 'n' || count(*) AS summary FROM story_members WHERE position <= 3 GROUP BY story_id HAVING count(*) > 1),
t AS (SELECT story_id, list(topic_id ORDER BY weight DESC, topic_id) AS topic_ids FROM story_topics GROUP BY ALL)
SELECT stories.story_id, category, summary, COALESCE(topic_ids, []) AS topic_ids FROM stories LEFT JOIN s USING (story_id) LEFT JOIN t USING (story_id)""")
def story_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = T.story_members(spark, sf_dir)
    summaries = m.filter("position <= 3").groupBy("story_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("story_id", F.concat(F.lit("n"), F.col("n").cast("string")).alias("summary"))
    return stories.cards(T.stories(spark, sf_dir).select("story_id", "category"), stories.topics(m), summaries)


@R.add(f"""{sql_with('sources', 'story_members', 'stories')},\n{_PRIMARY},
n AS (SELECT m.story_id, list(COALESCE(s.name, 'Bilinmeyen kaynak') ORDER BY m.position <> p.position, m.published_at, m.position, m.source_id) AS source_names FROM story_members m LEFT JOIN sources s USING (source_id) LEFT JOIN primaries p USING (story_id) GROUP BY m.story_id)
SELECT stories.story_id, published_at, source_names FROM stories LEFT JOIN n USING (story_id)""")
def story_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = T.story_members(spark, sf_dir), T.sources(spark, sf_dir)
    return stories.details(T.stories(spark, sf_dir).select("story_id", "published_at"), m, s, stories.primary(m, s))


@R.add(f"""{sql_with('stories', 'interactions')}
SELECT stories.story_id, b.story_id IS NOT NULL AS is_bookmarked FROM stories LEFT JOIN (SELECT DISTINCT story_id FROM interactions WHERE kind = 'Bookmark' AND user_id = 7) b ON b.story_id = stories.story_id""")
def bookmark_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = T.interactions(spark, sf_dir).filter("kind = 'Bookmark'")
    return readers.with_bookmarks(T.stories(spark, sf_dir).select("story_id"), marks, 7)


_RING = "PARTITION BY user_id ORDER BY occurred_at, story_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@R.add(f"""{sql_with('interactions')}
SELECT user_id, story_id, COALESCE(lag(story_id) OVER o, last_value(story_id) OVER ({_RING})) AS previous, COALESCE(lead(story_id) OVER o, first_value(story_id) OVER ({_RING})) AS next
FROM interactions WINDOW o AS (PARTITION BY user_id ORDER BY occurred_at, story_id)""")
def slideshow_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.neighbours(T.interactions(spark, sf_dir), "user_id", [F.col("occurred_at"), F.col("story_id")], "story_id")


@R.add(f"{sql_with('sources')}\nSELECT source_id, name, is_official FROM sources ORDER BY is_official DESC, name LIMIT 100")
def source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.sources(spark, sf_dir)
    return stories.page(s, [F.desc("is_official"), F.col("name")], 1, 100).select("source_id", "name", "is_official")


@R.add("""SELECT r_name AS region, n_name AS nation, s.n AS suppliers, c.n AS customers FROM nation JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL) s ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL) c ON c_nationkey = n_nationkey""")
def region_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: T.table(spark, sf_dir, n)
    count = lambda df, key, name: df.groupBy(F.col(key).alias("n_nationkey")).agg(F.count(F.lit(1)).alias(name))
    joined = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(count(t("supplier"), "s_nationkey", "suppliers"), "n_nationkey", "left").join(count(t("customer"), "c_nationkey", "customers"), "n_nationkey", "left")
    return joined.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "suppliers", "customers")


@R.add(f"SELECT event_id, CASE WHEN minutes < 1 THEN 'az önce' WHEN minutes < 60 THEN CAST(minutes AS BIGINT) || ' dk önce' WHEN hours < 24 THEN CAST(hours AS BIGINT) || ' sa önce' WHEN days < 7 THEN CAST(days AS BIGINT) || ' gün önce' ELSE day(ts) || '.' || month(ts) || '.' END AS label FROM (SELECT *, floor(hours / 24 + 0.5) AS days FROM (SELECT *, floor(minutes / 60 + 0.5) AS hours FROM (SELECT event_id, ts, floor((epoch_us(TIMESTAMP '{EVENT_NOW}') - epoch_us(ts)) / 60e6 + 0.5) AS minutes FROM events)))")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    return e.select("event_id", text.time_ago(F.col("ts").cast("timestamp"), at(EVENT_NOW)).alias("label"))


@R.add(f"SELECT user_id, hour(occurred_at + INTERVAL 3 HOUR) AS local_hour, count(*) AS n FROM ({sql_with('interactions')} SELECT * FROM interactions) WHERE hour(occurred_at + INTERVAL 3 HOUR) = 8 GROUP BY ALL")
def readers_at_digest_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = dates.local(F.col("occurred_at"), F.lit("Europe/Istanbul"), ["Europe/Istanbul"])
    i = T.interactions(spark, sf_dir).withColumn("local_hour", F.hour(zone).cast("long"))
    return i.filter("local_hour = 8").groupBy("user_id", "local_hour").agg(F.count(F.lit(1)).alias("n"))
