"""Queries over articles and pages: text forms, ingest, changes to tables, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import loose_json, text, urls
from ..operators import ingest
from ..sources import feeds, readable
from ..sources import tables as T
from ..sources.tables import EVENT_NOW, at, sql_with
from .discovery import norm_sql
from .registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql

_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_TITLE = norm_sql("title")


@R.add(f"{sql_with('articles')} SELECT article_id, {norm_sql('content')} AS normal FROM articles")
def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).select("article_id", text.normalize(F.col("content")).alias("normal"))


@R.add(f"""{sql_with('articles')}, t AS (SELECT article_id, list_filter(string_split({_TITLE}, ' '), lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x)) AS tokens FROM articles)
SELECT article_id, tokens, CASE WHEN len(tokens) = 0 THEN [] WHEN len(tokens) < 2 THEN [array_to_string(tokens, ' ')] ELSE list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]) END AS shingles FROM t""")
def title_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = T.articles(spark, sf_dir).select("article_id", text.normalize(F.col("title")).alias("n")).select("article_id", text.tokenize(F.col("n")).alias("tokens"))
    return tokens.select("article_id", "tokens", text.shingles(F.col("tokens")).alias("shingles"))


@R.add(f"""{sql_with('articles')}, s AS (SELECT article_id, replace({_TITLE}, ' ', '-') AS s FROM articles), c AS (SELECT *, left(s, 80) AS c, 80 - instr(reverse(left(s, 80)), '-') AS last FROM s),
g AS (SELECT article_id, CASE WHEN length(s) <= 80 THEN s WHEN instr(c, '-') > 0 AND last > 40 THEN left(c, last) ELSE c END AS slug, replace({_TITLE}, ' ', '-') AS s, md5(CAST(article_id AS VARCHAR)) AS id FROM c JOIN articles USING (article_id)),
u AS (SELECT *, left(s, 72) AS v, 72 - instr(reverse(left(s, 72)), '-') AS vlast FROM g)
SELECT article_id, slug, CASE WHEN s = '' THEN right(id, 8) ELSE CASE WHEN length(s) <= 72 THEN s WHEN instr(v, '-') > 0 AND vlast > 36 THEN left(v, vlast) ELSE v END || '-' || right(id, 8) END AS unique_slug FROM u""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.articles(spark, sf_dir).select("article_id", text.normalize(F.col("title")).alias("n"))
    return n.select("article_id", text.slugify(F.col("n")).alias("slug"), text.slugify_unique(F.col("n"), F.md5(F.col("article_id").cast("string").cast("binary"))).alias("unique_slug"))


@R.add(r"""WITH t AS (SELECT page_id, regexp_replace(replace(regexp_replace(html, '<[^>]*(?:>|$)', ' ', 'g'), '>', ''), '\s+', ' ', 'g') AS t FROM pages)
SELECT page_id, nullif(trim(replace(replace(replace(replace(replace(replace(replace(t, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&amp;', '&')), '') AS text FROM t""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@R.add()
def readable_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", readable.readable_body(F.col("html")).alias("body"))


_TRACK = "^(?:" + "|".join(urls.TRACKING_PREFIXES) + ")|^(?:" + "|".join(urls.TRACKING) + ")$"
_URL = f"""u AS (SELECT page_id, trim(url) AS u, regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\\?([^#]*))?', ['scheme', 'host', 'port', 'path', 'query']) AS x FROM pages),
k AS (SELECT page_id, u, x, list_sort(list_filter(string_split(x.query, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '{_TRACK}'))) AS q FROM u),
canonical AS (SELECT page_id, CASE WHEN x.host = '' THEN u ELSE CASE WHEN lower(x.scheme) = 'http' THEN 'https' ELSE lower(x.scheme) END || '://' || regexp_replace(lower(x.host), '^www\\.', '')
    || CASE WHEN x.port = '' OR (lower(x.scheme) = 'http' AND x.port = '80') OR (lower(x.scheme) = 'https' AND x.port = '443') THEN '' ELSE ':' || x.port END
    || CASE WHEN length(x.path) > 1 THEN regexp_replace(x.path, '/+$', '') WHEN x.path = '' THEN '/' ELSE x.path END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END END AS url FROM k)"""


@R.add(f"WITH {_URL} SELECT * FROM canonical")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"))


_SENT = "list_transform(list_filter(list_transform(string_split_regex(content, '[.!?\\n]'), lambda s: trim(s)), lambda s: length(s) > 25), lambda s: s || '.')"
_CATEGORY = "CASE " + " ".join(f"WHEN contains(n, '{k}') THEN '{v}'" for k, v in text.CATEGORY_KEYWORDS) + f" ELSE '{text.DEFAULT_CATEGORY}' END"


@R.add(f"""{sql_with('articles')}, s AS (SELECT article_id, title, content, {_SENT} AS s, {norm_sql("concat_ws(' ', title, content)")} AS n FROM articles)
SELECT article_id, s[1] AS dek, CASE WHEN len(s) > 0 THEN left(array_to_string(s[1:3], ' '), 1200) ELSE title END AS summary, list_transform(s[2:4], lambda x: left(x, 200)) AS key_points, {_CATEGORY} AS category,
    CAST(least(greatest(ceil(len(list_filter(string_split(content, ' '), lambda w: w <> '')) / 200.0), 1), 10) AS INTEGER) AS reading_minutes FROM s""")
def extractive_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir).select("article_id", "title", "content", text.sentences(F.col("content")).alias("s"))
    summary = F.when(F.size("s") > 0, F.substring(F.array_join(F.slice("s", 1, 3), " "), 1, 1200)).otherwise(F.col("title"))
    return a.select(
        "article_id", F.try_element_at("s", F.lit(1)).alias("dek"), summary.alias("summary"), F.transform(F.slice("s", 2, 3), lambda x: F.substring(x, 1, 200)).alias("key_points"),
        text.category(text.normalize(F.concat_ws(" ", "title", "content"))).alias("category"), text.reading_minutes(F.col("content")).alias("reading_minutes"),
    )


@R.add(f"""{sql_with('articles')}, s AS (SELECT article_id, title, COALESCE(({_SENT})[1], title) AS dek FROM articles), b AS (SELECT article_id, trim(regexp_replace(lower(dek), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS a, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS b FROM s)
SELECT article_id, a = '' OR a = b OR (starts_with(a, b) AND length(a) - length(b) < 12) AS redundant FROM b""".replace("(list_transform(list_filter(list_transform(string_split_regex(content", "(list_transform(list_filter(list_transform(string_split_regex(content"))
def redundant_deks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir).select("article_id", "title", F.coalesce(F.try_element_at(text.sentences(F.col("content")), F.lit(1)), F.col("title")).alias("dek"))
    return a.select("article_id", text.redundant(F.col("dek"), F.col("title")).alias("redundant"))


_ITEMS = f"items AS (SELECT page_id % 7 AS source_id, page_id % 200 AS external_id, page_id AS position, url AS canonical_url FROM canonical), known AS (SELECT page_id % 7 AS source_id, page_id % 200 AS external_id, url AS canonical_url FROM canonical WHERE page_id % 5 = 0)"


@R.add(f"""WITH {_URL}, {_ITEMS}, fresh AS (SELECT * FROM items i WHERE NOT EXISTS (FROM known k WHERE k.source_id = i.source_id AND k.external_id = i.external_id) AND canonical_url NOT IN (SELECT canonical_url FROM known)),
a AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY position, external_id) = 1)
SELECT source_id, external_id, canonical_url FROM a QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY position) = 1""")
def new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("source_id"), (F.col("page_id") % 200).alias("external_id"), F.col("page_id").alias("position"), "url")
    known = p.filter("position % 5 = 0").select("source_id", "external_id", urls.canonical_url(F.col("url")).alias("canonical_url"))
    return ingest.new_items(p, known).select("source_id", "external_id", "canonical_url")


@R.add(f"""WITH g AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN TIMESTAMP '{EVENT_NOW}' WHEN event_id % 13 = 0 THEN ts + INTERVAL 30 DAY ELSE ts END AS t FROM events)
SELECT event_id, CASE WHEN t > TIMESTAMP '{EVENT_NOW}' + INTERVAL 1 HOUR THEN TIMESTAMP '{EVENT_NOW}' ELSE t END AS published_at FROM g WHERE t >= TIMESTAMP '{EVENT_NOW}' - INTERVAL 14 DAY""")
def dated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, F.col("ts") + F.make_dt_interval(days=F.lit(30))).otherwise(F.col("ts"))
    return ingest.dated(e.select("event_id", t.alias("published_at")), at(EVENT_NOW))


@R.add(f"""WITH s AS (SELECT s_suppkey AS source_id, s_nationkey % 4 <> 0 AS on_, CASE WHEN s_suppkey % 9 <> 0 THEN TIMESTAMP '{EVENT_NOW}' - s_suppkey * INTERVAL 37 MINUTE END AS f, s_suppkey % 8 AS n FROM supplier)
SELECT source_id FROM s WHERE on_ AND (f IS NULL OR epoch(TIMESTAMP '{EVENT_NOW}') - epoch(f) >= 1800 * least(pow(2, n), 24))""")
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    fetched = F.when(k % 9 != 0, F.timestamp_seconds(F.unix_timestamp(at(EVENT_NOW)) - k * 37 * 60))
    s = T.table(spark, sf_dir, "supplier").select(k.alias("source_id"), (F.col("s_nationkey") % 4 != 0).alias("is_enabled"), fetched.alias("last_fetched_at"), (k % 8).alias("consecutive_failures"), F.lit(30).alias("fetch_interval_minutes"))
    return ingest.due(s, at(EVENT_NOW)).select("source_id")


@R.add("SELECT source, count(*) AS fetched, count(*) FILTER (n_chars >= 600) AS created, count(*) FILTER (n_chars < 100) AS failed FROM documents GROUP BY source")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("n_chars") >= 600, "created").when(F.col("n_chars") < 100, "failed").otherwise("skipped")
    return ingest.report(T.table(spark, sf_dir, "documents").select("source", status.alias("status")), "source")


@R.add("""WITH t AS (SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part WHERE p_partkey % 3 <> 0), c AS (SELECT p_partkey AS k, upper(p_name) AS name, p_size + 1 AS size FROM part WHERE p_partkey % 2 = 0)
SELECT COALESCE(t.k, c.k) AS k, COALESCE(c.name, t.name) AS name, COALESCE(t.size, c.size) AS size FROM t FULL JOIN c ON c.k = t.k""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``size`` belongs to operators: an update leaves it."""
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return ingest.upsert(p.filter("k % 3 <> 0"), p.filter("k % 2 = 0").select("k", F.upper("name").alias("name"), (F.col("size") + 1).alias("size")), "k", ["size"])


@R.add("""WITH t AS (SELECT l_orderkey AS story_id, l_partkey % 43 AS topic_id, max(l_discount) AS weight FROM lineitem GROUP BY ALL), o AS (FROM t WHERE story_id % 4 < 3), n AS (SELECT story_id, topic_id, CASE WHEN topic_id % 5 = 0 THEN 1.0 ELSE weight END AS weight FROM t WHERE story_id % 4 > 0)
SELECT COALESCE(o.story_id, n.story_id) AS story_id, COALESCE(o.topic_id, n.topic_id) AS topic_id, CASE WHEN o.story_id IS NULL THEN 'insert' WHEN n.story_id IS NULL THEN 'delete' WHEN o.weight = n.weight THEN 'keep' ELSE 'update' END AS action, COALESCE(n.weight, o.weight) AS weight
FROM o FULL JOIN n ON o.story_id = n.story_id AND o.topic_id = n.topic_id""")
def topic_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = T.table(spark, sf_dir, "lineitem")
    t = i.groupBy(F.col("l_orderkey").alias("story_id"), (F.col("l_partkey") % 43).alias("topic_id")).agg(F.max("l_discount").alias("weight"))
    new = t.filter("story_id % 4 > 0").withColumn("weight", F.when(F.col("topic_id") % 5 == 0, 1.0).otherwise(F.col("weight")))
    return ingest.sync_actions(t.filter("story_id % 4 < 3"), new, ["story_id", "topic_id"], "weight")


@R.add("""WITH i AS (SELECT user_id, event_id % 43 AS topic_id, max(value / 20) AS weight, min(event_id) % 2 = 0 AS is_explicit FROM events GROUP BY ALL), c AS (SELECT DISTINCT user_id, event_id % 43 AS topic_id FROM events WHERE event_type = 'view' AND event_id % 3 = 0)
SELECT COALESCE(c.user_id, i.user_id) AS user_id, COALESCE(c.topic_id, i.topic_id) AS topic_id, CASE WHEN c.user_id IS NOT NULL THEN greatest(COALESCE(weight, 1.0), 1.0) ELSE weight END AS weight, c.user_id IS NOT NULL OR is_explicit AS is_explicit
FROM i FULL JOIN c ON c.user_id = i.user_id AND c.topic_id = i.topic_id WHERE c.user_id IS NOT NULL OR NOT is_explicit""")
def explicit_interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 43).alias("topic_id"), "event_id", "event_type", "value")
    own = e.groupBy("user_id", "topic_id").agg(F.max(F.col("value") / 20).alias("weight"), (F.min("event_id") % 2 == 0).alias("is_explicit"))
    return ingest.replace_explicit(own, e.filter("event_type = 'view' AND event_id % 3 = 0").select("user_id", "topic_id").distinct())


@R.add("SELECT user_id, event_id % 97 AS story_id FROM events WHERE event_type = 'click' GROUP BY ALL HAVING count(*) % 2 = 1")
def toggled_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.toggled(T.table(spark, sf_dir, "events").filter("event_type = 'click'").select("user_id", (F.col("event_id") % 97).alias("story_id")), ["user_id", "story_id"])


@R.add("""WITH t AS (SELECT event_type AS topic, CAST(date_trunc('week', ts) AS DATE) AS period_start, count(*) AS n FROM events GROUP BY ALL)
SELECT * FROM t WHERE period_start < DATE '2024-01-15' UNION ALL SELECT topic, period_start, n + 1 FROM t WHERE period_start >= DATE '2024-01-15' AND topic <> 'error'""")
def replaced_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    t = e.groupBy(F.col("event_type").alias("topic"), F.to_date(F.date_trunc("week", "ts")).alias("period_start")).agg(F.count(F.lit(1)).alias("n"))
    return ingest.replace_from(t, t.filter("topic <> 'error'").withColumn("n", F.col("n") + 1), "period_start", F.lit("2024-01-15").cast("date"))


@R.add(f"""{sql_with('story_members', 'stories')} SELECT s.story_id, category, CAST(epoch(s.published_at) AS BIGINT) AS published_unix, COALESCE(t.topics, []) AS topics FROM stories s LEFT JOIN (SELECT story_id, list_sort(list(DISTINCT topic_id)) AS topics FROM story_members GROUP BY ALL) t ON t.story_id = s.story_id""")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.search_documents(T.stories(spark, sf_dir), T.story_members(spark, sf_dir))


@R.add("""SELECT event_id, 'n' || event_id AS name, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, CASE WHEN event_id % 4 = 0 THEN -1.0 ELSE value END AS v, ['a', CAST(event_id % 3 AS VARCHAR)] AS tags FROM events""")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers are made of events: fenced, with numbers as strings, comments and trailing commas."""
    value = F.when(F.col("event_id") % 4 == 0, '"none"').otherwise(F.col("value").cast("string"))
    said = F.concat(F.lit("Here:\n```json\n{\"name\": \"n"), F.col("event_id"), F.lit("\", // a name\n \"k\": \""), F.regexp_extract("props", "[0-9]+", 0), F.lit("\", \"v\": "), value, F.lit(", \"tags\": [\"a\", \""), (F.col("event_id") % 3).cast("string"), F.lit("\",],}\n```\ndone"))
    j = T.table(spark, sf_dir, "events").select("event_id", loose_json.extract(said).alias("j"))
    return j.select("event_id", loose_json.string(F.col("j"), "name").alias("name"), loose_json.number(F.col("j"), "k").alias("k"), loose_json.number(F.col("j"), "v", -1.0).alias("v"), loose_json.strings(F.col("j"), "tags").alias("tags"))


@R.add("""SELECT CAST(event_id AS VARCHAR) AS external_id, user_id AS source_id, 'https://news.ycombinator.com/item?id=' || event_id AS url, event_type AS title, CAST(trunc(value) AS INTEGER) AS engagement_score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 50 AND trunc(value) >= 25 AND event_id % 3 <> 0""")
def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    item = F.to_json(F.struct(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "job").otherwise("story").alias("type"), F.col("value").cast("int").alias("score"), F.col("event_type").alias("title"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("time")))
    return feeds.hacker_news(e.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("position"), item.alias("body"))).select("external_id", "source_id", "url", "title", "engagement_score")


@R.add("""WITH c AS (SELECT o_custkey, o_orderkey, CAST(trunc(o_totalprice / 1000) AS INTEGER) AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p, o_orderpriority FROM orders)
SELECT o_custkey AS source_id, CAST(o_orderkey AS VARCHAR) AS external_id, 'https://www.reddit.com/r/' || o_orderkey AS url, o_orderpriority AS title, score AS engagement_score FROM c WHERE score >= 40 AND o_orderkey % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY p) <= 50""")
def forum_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders")
    post = F.struct(F.col("o_orderkey"), F.struct(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("/r/"), F.col("o_orderkey")).alias("permalink"), F.col("o_orderpriority").alias("title"), (F.col("o_totalprice") / 1000).cast("int").alias("score"), (F.col("o_orderkey") % 7 == 0).alias("stickied"), F.lit(True).alias("is_self")).alias("data"))
    listing = F.to_json(F.struct(F.struct(F.transform(F.array_sort(F.collect_list(post)), lambda x: F.struct(x["data"].alias("data"))).alias("children")).alias("data")))
    return feeds.reddit(o.groupBy(F.col("o_custkey").alias("source_id")).agg(listing.alias("body"))).select("source_id", "external_id", "url", "title", "engagement_score")


@R.add("SELECT page_id AS page, CAST(u.i - 1 AS INTEGER) AS position, 'meta_' || (u.i - 1) AS id, u.x AS image_url FROM (SELECT page_id, unnest(list_transform(regexp_extract_all('<meta property=\"og:image\" content=\"' || url || '\">' || html, '<meta[^>]+property=\"og:image\"[^>]+content=\"([^\"]+)\"', 1), lambda x, i: {'x': x, 'i': i})) AS u FROM pages)")
def page_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit('<meta property="og:image" content="'), "url", F.lit('">'), "html").alias("html"))
    return feeds.photos(p, "page_id", "html").select("page", "position", "id", "image_url")


@R.add("""WITH i AS (SELECT page_id % 7 AS s, page_id, url, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS k FROM pages)
SELECT CAST(s AS VARCHAR) AS source_id, 'g' || page_id AS external_id, url, 'Item <' || page_id || '>' AS title, 'about & ' || page_id AS excerpt, TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 MINUTE AS published_at FROM i WHERE k <= 50 AND page_id % 4 <> 0""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS made of pages: escaped titles, marked-up descriptions, every fourth item without a title."""
    i = F.col("page_id")
    escaped = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    title = F.when(i % 4 != 0, F.concat(F.lit("Item &amp;lt;"), i.cast("string"), F.lit("&amp;gt;"))).otherwise("")
    about = F.concat(F.lit("&lt;p&gt;about&lt;/p&gt; &amp;amp; "), i.cast("string"))
    when = F.date_format(F.timestamp_seconds(F.unix_timestamp(at("2024-01-01 00:00:00")) + i * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = tag("item", F.concat(tag("title", title), tag("link", escaped(F.col("url"))), tag("guid", F.concat(F.lit("g"), i.cast("string"))), tag("description", about), tag("pubDate", when)))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("x")))), lambda r: r["x"]), "")
    fetched = T.table(spark, sf_dir, "pages").groupBy((i % 7).alias("source_id")).agg(F.concat(F.lit("<rss><channel>"), listed, F.lit("</channel></rss>")).alias("body")).withColumn("kind", F.lit("Rss"))
    return feeds.rss(fetched).select("source_id", "external_id", "url", "title", "excerpt", "published_at")


@R.add("""WITH r AS (SELECT p_size AS source_id, p_partkey AS id, p_name, p_brand, CAST(trunc(p_retailprice) AS INTEGER) AS stars, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 6 <> 0)
SELECT source_id, CAST(id AS VARCHAR) AS external_id, 'https://github.com/' || p_name AS url, p_name || ': ' || CASE WHEN id % 5 = 0 THEN 'yeni depo' ELSE p_brand END AS title, concat_ws(' ', CASE WHEN id % 5 <> 0 THEN p_brand END, 'Dil: C#.', stars || ' yıldız, 0 fork.', 'Konular: a, b.') AS content, stars AS engagement_score FROM r WHERE k <= 50""")
def trending_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    repo = F.struct(k, F.struct(k.alias("id"), F.when(k % 6 != 0, F.col("p_name")).alias("full_name"), F.when(k % 5 != 0, F.col("p_brand")).alias("description"), F.lit("C#").alias("language"), F.col("p_retailprice").cast("int").alias("stargazers_count"), F.array(F.lit("a"), F.lit("b")).alias("topics")).alias("r"))
    body = F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(repo)), lambda x: x["r"]).alias("items")))
    return feeds.github(p.groupBy(F.col("p_size").alias("source_id")).agg(body.alias("body"))).select("source_id", "external_id", "url", "title", "content", "engagement_score")


@R.add("""WITH u AS (SELECT page_id, unnest([{'p': 0, 'u': 'http://m/' || page_id || '/a.jpg', 'c': 'One ' || page_id}, {'p': 1, 'u': 'http://m/' || page_id || '/b.jpg', 'c': CASE WHEN page_id % 2 = 0 THEN 'Two' END}]) AS x FROM pages)
SELECT page_id, CAST(x.p AS INTEGER) AS position, 'imginn_' || x.p AS id, x.u AS image_url, x.c AS caption FROM u""")
def mirror_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of a mirror that loads them late: one twice, a thumbnail, a relative one."""
    i = F.col("page_id").cast("string")
    image = lambda attribute, path: F.concat(F.lit(f'<img class="post-image" {attribute}="'), path, F.lit('">'))
    url = lambda name: F.concat(F.lit("http://m/"), i, F.lit(f"/{name}.jpg"))
    said = lambda c: F.concat(F.lit('<div class="photo-description"><b>'), c, F.lit("</b></div>"))
    html = F.concat(image("src", url("a")), said(F.concat(F.lit("One "), i)), image("data-src", url("b")), image("src", url("a")), image("src", url("s150x150")), image("src", F.lit("/c.jpg")), F.when(F.col("page_id") % 2 == 0, said(F.lit("Two"))).otherwise(""))
    p = T.table(spark, sf_dir, "pages").select("page_id", F.posexplode(feeds.mirror_images(html, "imginn_", True)).alias("position", "x"))
    return p.select("page_id", "position", "x.id", "x.image_url", "x.caption")
