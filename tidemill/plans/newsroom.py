"""Queries of the newsroom: search with filters, queues, prompt contexts, refreshed stories, digests, profiles, learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text, vectors
from ..operators import editorial, ingest, search, stories
from ..sources import tables as T
from ..sources.tables import STORY_NOW, at, sql_with
from . import discovery, news
from .discovery import norm_sql
from .registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql

_SINCE, _UNTIL = "1999-01-01 00:00:00", "2001-06-01 00:00:00"
_SEARCHED = f"status = 'Published' AND published_at >= TIMESTAMP '{_SINCE}' AND published_at <= TIMESTAMP '{_UNTIL}' AND trust_score >= 50 AND official_source_count > 0"


@R.add(f"{news.SCORED}, {news._TOPICS} SELECT story_id, category, trust_score FROM scored WHERE {_SEARCHED} AND category = 'Ai' AND story_id IN (SELECT story_id FROM story_topics WHERE topic_id IN (3, 5, 8))")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = stories.topics(T.story_members(spark, sf_dir))
    return editorial.searched(news.scored(spark, sf_dir), topics, at(_SINCE), at(_UNTIL), "Ai", 50, True, [3, 5, 8]).select("story_id", "category", "trust_score")


@R.add(f"""WITH parsed AS ({discovery.SQL['parsed_queries']}), {news.SCORED.removeprefix('WITH ')}, k AS (SELECT DISTINCT days, official_only FROM parsed),
c AS (SELECT days, official_only, count(*) AS n, arg_max(story_id, (epoch_us(published_at), story_id)) AS latest FROM k JOIN scored ON status = 'Published' AND (days IS NULL OR published_at >= TIMESTAMP '{STORY_NOW}' - days * INTERVAL 1 DAY) AND (NOT official_only OR official_source_count > 0) GROUP BY ALL)
SELECT k.days, k.official_only, COALESCE(n, 0) AS n, latest FROM k LEFT JOIN c ON k.days IS NOT DISTINCT FROM c.days AND k.official_only = c.official_only""")
def asked_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters of parsed questions, applied to stories."""
    return editorial.asked(discovery.parsed_queries(spark, sf_dir), news.scored(spark, sf_dir), at(STORY_NOW))


@R.add(f"{news.SCORED}, {news._TOPICS} SELECT story_id, importance_score FROM scored WHERE status = 'Published' AND story_id IN (SELECT story_id FROM story_topics WHERE topic_id = 7) ORDER BY importance_score DESC, published_at DESC, story_id LIMIT 50")
def topic_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = editorial.searched(news.scored(spark, sf_dir), stories.topics(T.story_members(spark, sf_dir)), topic_ids=[7])
    return stories.page(f, [F.desc("importance_score"), F.desc("published_at"), F.col("story_id")], 1, 50).select("story_id", "importance_score")


_BODY = "'body ' || story_id || ' ' || repeat('x', CAST(position * 600 AS BIGINT))"
_PRIMARIES = f"{sql_with('sources', 'story_members')}, {news._PRIMARY}"
_SOURCED = "story_members m LEFT JOIN sources s USING (source_id) LEFT JOIN primaries p USING (story_id)"


@R.add(f"""{_PRIMARIES}, k AS (SELECT m.story_id, left({_BODY.replace('story_id', 'm.story_id').replace('position', 'm.position')}, 2500) AS x, COALESCE(name, 'Bilinmeyen kaynak') AS s,
    row_number() OVER (PARTITION BY m.story_id ORDER BY CASE WHEN m.position = p.position AND m.source_id = p.primary_source_id THEN 0 ELSE 1 END, NOT COALESCE(is_official, false), m.published_at, m.position, m.source_id) AS k FROM {_SOURCED}),
l AS (SELECT story_id, list(x ORDER BY k) AS excerpts, list(s ORDER BY k) AS names FROM k WHERE k <= 6 GROUP BY story_id)
SELECT story_id, excerpts, list_filter(names, lambda v, i: list_position(names, v) = i) AS source_names FROM l""")
def prompt_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = T.story_members(spark, sf_dir), T.sources(spark, sf_dir)
    body = F.concat(F.lit("body "), F.col("story_id").cast("string"), F.lit(" "), F.expr("repeat('x', CAST(position * 600 AS INT))"))
    return editorial.prompt_contexts(m.withColumn("body", body), s, stories.primary(m, s))


_LINKS = "links AS (SELECT story_id, position, 'https://e/' || story_id || '/' || position AS url FROM story_members WHERE position % 2 = 1)"


@R.add(f"""{sql_with('sources', 'story_members', 'stories')}, {news._PRIMARY}, {news._TOPICS}, {_LINKS},
a AS (SELECT m.story_id, list({{'name': COALESCE(name, 'Bilinmeyen kaynak'), 'is_official': COALESCE(is_official, false)}} ORDER BY CASE WHEN m.position = p.position AND m.source_id = p.primary_source_id THEN 0 ELSE 1 END, m.published_at, m.position, m.source_id) AS sources FROM {_SOURCED} GROUP BY m.story_id),
b AS (SELECT story_id, list(url ORDER BY position) AS links FROM links GROUP BY story_id), c AS (SELECT story_id, list(topic_id ORDER BY weight DESC, topic_id) AS topics FROM story_topics GROUP BY story_id)
SELECT stories.story_id, category, sources, COALESCE(links, []) AS links, COALESCE(topics, []) AS topics FROM stories LEFT JOIN a USING (story_id) LEFT JOIN b USING (story_id) LEFT JOIN c USING (story_id)""")
def story_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = T.story_members(spark, sf_dir), T.sources(spark, sf_dir)
    links = m.filter("position % 2 = 1").select("story_id", "position", F.concat_ws("/", F.lit("https://e"), "story_id", "position").alias("url"))
    return editorial.details(T.stories(spark, sf_dir).select("story_id", "category"), m, s, stories.primary(m, s), links, stories.topics(m))


@R.add("""WITH d AS (SELECT doc_id AS story_id, [COALESCE(source, ''), COALESCE(lang, ''), 'general'] AS slugs, MAP {'en': 'English note', 'src1': '  ', 'general': CASE WHEN doc_id % 3 = 0 THEN 'For all' END} AS notes FROM documents)
SELECT story_id, list_filter(list_transform(slugs, lambda s: notes[s]), lambda n: n IS NOT NULL AND trim(n) <> '')[1] AS note FROM d""")
def personal_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents")
    slugs = F.array(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.lit("general"))
    notes = F.create_map(F.lit("en"), F.lit("English note"), F.lit("src1"), F.lit("  "), F.lit("general"), F.when(F.col("doc_id") % 3 == 0, "For all"))
    return d.select(F.col("doc_id").alias("story_id"), editorial.personal_note(notes, slugs).alias("note"))


_PROFILES = """i AS (SELECT user_id, list(topic_id ORDER BY weight DESC, topic_id) AS topic_ids FROM interests GROUP BY user_id), k AS (SELECT DISTINCT user_id FROM interactions)"""


@R.add(f"""WITH s AS ({news.SQL['reader_streaks']}), {", ".join(T.SQL[k] for k in ('interactions', 'interests'))}, {_PROFILES}
SELECT k.user_id, 'Mid' AS experience_level, CASE WHEN k.user_id % 3 = 0 THEN k.user_id % 24 ELSE 8 END AS digest_hour, CASE WHEN k.user_id % 3 = 0 THEN 3 + k.user_id % 28 ELSE 10 END AS story_count, 15 AS learning_minutes,
    CASE WHEN k.user_id % 5 <> 0 THEN s.current ELSE 0 END AS current, CASE WHEN k.user_id % 5 <> 0 THEN s.longest ELSE 0 END AS longest, 5 AS weekly_goal_days, COALESCE(topic_ids, []) AS topic_ids FROM k LEFT JOIN s USING (user_id) LEFT JOIN i USING (user_id)""")
def reader_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = T.interactions(spark, sf_dir)
    u = F.col("user_id")
    settings = i.select("user_id").distinct().filter(u % 3 == 0).select("user_id", (u % 24).alias("digest_hour"), (u % 28 + 3).alias("story_count"))
    return editorial.profiles(i.select("user_id").distinct(), settings, T.interests(spark, sf_dir), news.reader_streaks(spark, sf_dir).filter(u % 5 != 0).select("user_id", "current", "longest"))


_DIGEST = "user_id, CAST(occurred_at AS DATE) AS date, story_id, CAST(row_number() OVER (PARTITION BY user_id, CAST(occurred_at AS DATE) ORDER BY value DESC, story_id) AS INTEGER) AS rank FROM interactions"


@R.add(f"""{sql_with('interactions')}, e AS (SELECT {_DIGEST} WHERE kind = 'Open'), n AS (SELECT {_DIGEST} WHERE kind <> 'Open')
SELECT * FROM e WHERE NOT (user_id % 2 = 0 AND (user_id, date) IN (SELECT (user_id, date) FROM n)) UNION ALL SELECT * FROM n WHERE user_id % 2 = 0 OR (user_id, date) NOT IN (SELECT (user_id, date) FROM e)""")
def digests_after_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers with an even id asked for a new digest."""
    i = T.interactions(spark, sf_dir).withColumn("date", F.to_date("occurred_at"))
    of = lambda d: d.withColumn("rank", F.row_number().over(editorial.Window.partitionBy("user_id", "date").orderBy(F.desc("value"), "story_id"))).select("user_id", "date", "story_id", "rank")
    return editorial.replaced_digests(of(i.filter("kind = 'Open'")), of(i.filter("kind <> 'Open'")), ["user_id", "date"], F.col("user_id") % 2 == 0)


@R.add("""WITH l AS (SELECT event_id, user_id, CAST(trunc(value * 60) AS INTEGER) AS dwell_seconds FROM events) SELECT * FROM l WHERE event_id % 4 = 0 OR dwell_seconds BETWEEN 0 AND 3600""")
def interaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that already holds every fourth event, and the valid ones of the rest."""
    e = T.table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") * 60).cast("int").alias("dwell_seconds"))
    return editorial.appended(e.filter("event_id % 4 = 0"), e.filter("event_id % 4 <> 0"), {"dwell_seconds": (0, 3600)})


@R.add("""SELECT user_id, list_filter([CASE WHEN event_id % 30 NOT BETWEEN 0 AND 23 THEN 'digest_hour' END, CASE WHEN event_id % 40 NOT BETWEEN 3 AND 30 THEN 'story_count' END, CASE WHEN length(props) > 12 THEN 'surface' END], lambda x: x IS NOT NULL) AS errors, event_id FROM events""")
def preference_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    rows = e.select("event_id", "user_id", (F.col("event_id") % 30).alias("digest_hour"), (F.col("event_id") % 40).alias("story_count"), F.col("props").alias("surface"))
    return editorial.validated(rows, {"digest_hour": (0, 23), "story_count": (3, 30)}, {"surface": 12}).select("event_id", "user_id", "errors")


@R.add(f"""{sql_with('interactions', 'interests')}, m AS (SELECT user_id, story_id % 43 AS topic_id FROM interactions WHERE kind = 'Mute' GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT user_id, topic_id, weight FROM interests i WHERE NOT EXISTS (FROM m WHERE m.user_id = i.user_id AND m.topic_id = i.topic_id)""")
def interests_after_mutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = T.interactions(spark, sf_dir).filter("kind = 'Mute'").select("user_id", (F.col("story_id") % T.TOPICS).alias("topic_id"))
    return editorial.unmuted_interests(T.interests(spark, sf_dir), log)


@R.add("""WITH t AS (SELECT p_partkey AS topic_id, lower(p_brand) || '-' || p_partkey AS slug FROM part), r AS (SELECT c_custkey AS user_id, unnest([' BRAND#11-' || (c_custkey % 500), 'brand#22-' || (c_custkey % 500), 'nothing', (SELECT any_value(slug) FROM t WHERE topic_id = 7), (SELECT '  ' || upper(any_value(slug)) FROM t WHERE topic_id = 7)]) AS s FROM customer)
SELECT user_id, topic_id, 1.0::DOUBLE AS weight, true AS is_explicit FROM (SELECT DISTINCT user_id, lower(trim(s)) AS slug FROM r) JOIN t USING (slug)""")
def registered_interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("topic_id"), F.concat_ws("-", F.lower("p_brand"), "p_partkey").alias("slug"))
    own = lambda brand: F.concat(F.lit(brand), (F.col("c_custkey") % 500).cast("string"))
    seventh = topics.filter("topic_id = 7").select(F.col("slug").alias("seventh"))
    c = T.table(spark, sf_dir, "customer").join(F.broadcast(seventh))
    return editorial.chosen_topics(c.select(F.col("c_custkey").alias("user_id"), F.array(own(" BRAND#11-"), own("brand#22-"), F.lit("nothing"), "seventh", F.concat(F.lit("  "), F.upper("seventh"))).alias("slugs")), topics)


_LEARN = "l AS (SELECT user_id, event_id % 20 AS suggestion_id, CASE event_type WHEN 'view' THEN 'Started' WHEN 'click' THEN 'Completed' WHEN 'purchase' THEN 'Completed' ELSE 'Skipped' END AS status, ts AS t, event_id AS seq FROM events)"


@R.add(f"""WITH {_LEARN}, m AS (SELECT *, status = 'Completed' AND COALESCE(lag(status) OVER (PARTITION BY user_id, suggestion_id ORDER BY t, seq), '') <> 'Completed' AS f FROM l)
SELECT user_id, suggestion_id, arg_max(status, (epoch_us(t), seq)) AS status, max(t) FILTER (status = 'Completed') AS completed_at, count(*) FILTER (f) AS completions FROM m GROUP BY ALL""")
def learning_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "Started").when(F.col("event_type").isin("click", "purchase"), "Completed").otherwise("Skipped")
    log = T.table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 20).alias("suggestion_id"), kind.alias("status"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    return editorial.learning(log)


@R.add("""WITH f AS (SELECT user_id, CAST(ts + INTERVAL 3 HOUR AS DATE) AS day, arg_min(event_id, (epoch_us(ts), event_id)) AS suggestion_id FROM events GROUP BY ALL)
SELECT user_id, day, suggestion_id, CAST(u.p AS INTEGER) AS position, u.r AS resource FROM (SELECT *, unnest([{'p': 1, 'r': 'book ' || suggestion_id}, {'p': 2, 'r': 'talk ' || suggestion_id % 7}]) AS u FROM f)""")
def daily_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    i = F.col("event_id")
    rows = e.select("user_id", i.alias("suggestion_id"), F.col("ts").cast("timestamp").alias("at"), F.array(F.concat(F.lit("book "), i.cast("string")), F.concat(F.lit("talk "), (i % 7).cast("string"))).alias("resources"))
    return editorial.once_daily(rows, F.to_date(dates.local(F.col("at"), F.lit("Europe/Istanbul"), ["Europe/Istanbul"])))


@R.add("WITH l AS (SELECT event_id AS suggestion_id, user_id, CAST(ts + INTERVAL 3 HOUR AS DATE) AS day FROM events) SELECT suggestion_id, user_id, day FROM l WHERE day <> DATE '2024-01-30'")
def learning_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isn't today's, by the reader's calendar."""
    e = T.table(spark, sf_dir, "events").select(F.col("event_id").alias("suggestion_id"), "user_id", F.col("ts").cast("timestamp").alias("at"))
    return editorial.history(e, F.to_date(dates.local(F.col("at"), F.lit("Europe/Istanbul"), ["Europe/Istanbul"])), F.lit("2024-01-30").cast("date")).select("suggestion_id", "user_id", "day")


@R.add(f"{news.SCORED} SELECT story_id, importance_score FROM scored WHERE status = 'Published' AND published_at >= TIMESTAMP '{STORY_NOW}' - INTERVAL 7 DAY ORDER BY importance_score DESC, story_id LIMIT 25")
def learning_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editorial.learning_context(news.scored(spark, sf_dir), at(STORY_NOW)).select("story_id", "importance_score")


@R.add(f"{sql_with('sources', 'story_members', 'stories')}, {news._AGG} SELECT story_id FROM stories JOIN agg USING (story_id) WHERE status = 'Draft' ORDER BY last_activity_at DESC, story_id LIMIT 200")
def enrichment_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.stories(spark, sf_dir).join(stories.aggregates(T.story_members(spark, sf_dir), T.sources(spark, sf_dir)).select("story_id", "last_activity_at"), "story_id")
    return editorial.queue(s, F.col("status").isin("Draft", "Enriching"), [F.desc("last_activity_at"), F.col("story_id")], 1000, 200).select("story_id")


@R.add(f"{sql_with('articles')} SELECT article_id FROM articles WHERE n_chars >= 600 AND article_id % 3 <> 0 ORDER BY published_at, article_id LIMIT 1000")
def clustering_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long articles are normalised, every third is in a story already."""
    a = T.articles(spark, sf_dir)
    return editorial.queue(a, (F.col("n_chars") >= 600) & (F.col("article_id") % 3 != 0), [F.col("published_at"), F.col("article_id")], 5000, 1000).select("article_id")


_VECTORS = "v AS (SELECT m.*, m.position = 2 AND m.story_id % 2 = 0 AS is_primary, e.embedding FROM story_members m LEFT JOIN embeddings e ON e.vec_id = m.story_id * 3 + m.position)"


@R.add(f"""{sql_with('sources', 'story_members', 'stories')}, {news._AGG}, {news._PRIMARY}, {_VECTORS}, g AS (SELECT story_id, min(position) AS position FROM v WHERE is_primary GROUP BY story_id), n AS (SELECT story_id, count(*) AS n FROM v GROUP BY story_id),
x AS (SELECT story_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM v), c AS (SELECT story_id, round(sum(m), 4) AS total FROM (SELECT story_id, i, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY ALL) GROUP BY story_id)
SELECT s.story_id, CASE WHEN status = 'Published' AND n > 1 THEN 'Enriching' ELSE status END AS status, distinct_source_count, engagement, last_activity_at, COALESCE(g.position, p.position) AS primary_position, total
FROM stories s JOIN agg USING (story_id) JOIN n USING (story_id) JOIN primaries p USING (story_id) LEFT JOIN g USING (story_id) LEFT JOIN c USING (story_id)""")
def refreshed_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = T.story_members(spark, sf_dir)
    v = m.select("story_id", (F.col("story_id") * 3 + F.col("position")).alias("vec_id")).join(T.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    m = m.withColumn("is_primary", (F.col("position") == 2) & (F.col("story_id") % 2 == 0))
    total = F.when(F.col("embedding").isNotNull(), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4))
    return editorial.refreshed(T.stories(spark, sf_dir), m, T.sources(spark, sf_dir), v).select("story_id", "status", "distinct_source_count", "engagement", "last_activity_at", "primary_position", total.alias("total"))


@R.add(f"""{sql_with('stories')} SELECT story_id, CASE WHEN status = 'Draft' AND story_id % 4 < 3 THEN CASE WHEN story_id % 4 > 0 THEN 'Published' ELSE 'Enriching' END ELSE status END AS status,
    status = 'Draft' AND story_id % 4 IN (1, 2) AS published, status = 'Draft' AND story_id % 4 = 0 AS failed FROM stories""")
def enrichment_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.stories(spark, sf_dir)
    return editorial.enriched(s, s.filter("story_id % 4 < 3").select("story_id", (F.col("story_id") % 4 > 0).alias("ok")))


def _slug_sql() -> str:
    title = "lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g'))"
    make = lambda hexed: f"{title} || '-' || right({hexed}, 8)"
    ctes = [f"l0 AS (SELECT p_partkey AS story_id, p_name, lpad(CAST(p_partkey % 40 AS VARCHAR), 8, '0') AS hex_id, {make('hex_id')} AS slug FROM (SELECT *, lpad(CAST(p_partkey % 40 AS VARCHAR), 8, '0') AS hex_id FROM part))", f"u0 AS (SELECT DISTINCT {make('hex_id')} AS slug FROM (SELECT *, lpad(CAST(p_partkey % 40 AS VARCHAR), 8, '0') AS hex_id FROM part WHERE p_partkey <= 20))"]
    for k in range(5):
        ctes.append(f"r{k} AS (SELECT l.*, u.slug IS NOT NULL OR row_number() OVER (PARTITION BY l.slug ORDER BY u.slug IS NOT NULL, story_id) > 1 AS lost FROM l{k} l LEFT JOIN u{k} u ON u.slug = l.slug)")
        ctes.append(f"w{k} AS (SELECT story_id, slug FROM r{k} WHERE NOT lost)")
        ctes.append(f"u{k + 1} AS (SELECT slug FROM u{k} UNION SELECT slug FROM w{k})")
        again = f"md5(story_id || ':{k + 1}')"
        ctes.append(f"l{k + 1} AS (SELECT story_id, p_name, hex_id, {make(again)} AS slug FROM r{k} WHERE lost)")
    last = "SELECT story_id, CASE WHEN u.slug IS NOT NULL OR row_number() OVER (PARTITION BY l.slug ORDER BY story_id) > 1 THEN hex_id ELSE l.slug END AS slug FROM l5 l LEFT JOIN u5 u ON u.slug = l.slug"
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(f'SELECT * FROM w{k}' for k in range(5))} UNION ALL {last}"


@R.add(_slug_sql())
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short ids, so that many slugs collide."""
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("story_id"), text.normalize(F.col("p_name")).alias("title_n"), F.lpad((F.col("p_partkey") % 40).cast("string"), 8, "0").alias("hex_id"))
    taken = p.filter("story_id <= 20").select(text.slugify_unique(F.col("title_n"), F.col("hex_id")).alias("slug"))
    return editorial.unique_slugs(p, taken)


@R.add("SELECT count(*) FILTER (n_chars >= 600) AS saved, count(*) FILTER (n_chars < 600) AS failed FROM documents")
def save_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.saved_and_failed(T.table(spark, sf_dir, "documents"), F.col("n_chars") >= 600)


@R.add("SELECT page_id, CAST(row_number() OVER (ORDER BY md5('show:' || page_id), page_id) AS INTEGER) AS place FROM pages ORDER BY md5('show:' || page_id), page_id LIMIT 6")
def preloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six of a seeded shuffle."""
    first = editorial.shuffled(T.table(spark, sf_dir, "pages").select("page_id"), "page_id", "show").limit(6)
    order = editorial.Window.orderBy(F.md5(F.concat_ws(":", F.lit("show"), F.col("page_id").cast("string")).cast("binary")), "page_id")
    return first.withColumn("place", F.row_number().over(order))


@R.add("WITH b AS (SELECT event_id, user_id, ['t' || event_id % 5, 't' || event_id % 7] AS tags FROM events WHERE event_type = 'purchase') SELECT event_id, user_id FROM b WHERE list_contains(tags, 't3')")
def tagged_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    tag = lambda n: F.concat(F.lit("t"), (F.col("event_id") % n).cast("string"))
    return search.tagged(e.withColumn("tags", F.array(tag(5), tag(7))), " t3 ").select("event_id", "user_id")


@R.add("WITH t AS (SELECT p_partkey AS topic_id, [p_name] || string_split(p_name, ' ') || [p_name] AS names FROM part) SELECT topic_id, list_filter(names, lambda v, i: list_position(names, v) = i) AS terms FROM t")
def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part")
    aliases = F.concat(F.split("p_name", " "), F.array("p_name"))
    return p.select(F.col("p_partkey").alias("topic_id"), search.topic_terms(F.col("p_name"), aliases).alias("terms"))


_CUT = "CASE WHEN trim({c}) = '' THEN {c} ELSE left(trim({c}), {n}) END"


@R.add(f"""{sql_with('articles')} SELECT article_id, length(COALESCE(content, '')) < 600 AS needs_page, upper(sha256({norm_sql("concat_ws(' ', title, content)")})) AS content_hash, {_CUT.format(c='title', n=500)} AS title, length({_CUT.format(c='content', n=50000)}) AS n_content FROM articles""")
def ingested_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir).select("article_id", "title", F.lit(None).cast("string").alias("excerpt"), "content")
    return ingest.derived(a).select("article_id", "needs_page", "content_hash", "title", F.length("content").cast("long").alias("n_content"))


@R.add("""WITH c AS (SELECT event_id, [event_id % 5, event_id % 3 + 3, 9] AS named, [event_id % 4, event_id % 6, 7, 8] AS ctx FROM events), d AS (SELECT event_id, list_filter(named, lambda v, i: list_position(named, v) = i AND list_contains(ctx, v)) AS own, ctx FROM c)
SELECT event_id, CASE WHEN len(own) > 0 THEN own ELSE ctx[1:3] END AS cited FROM d""")
def cited_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    named, context = F.array(i % 5, i % 3 + 3, F.lit(9).cast("long")), F.array(i % 4, i % 6, F.lit(7).cast("long"), F.lit(8).cast("long"))
    return T.table(spark, sf_dir, "events").select("event_id", search.citations(named, context).alias("cited"))


@R.add("WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 4) AS total FROM n")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


_GOOD = f"SELECT * FROM scored WHERE status = 'Published' AND published_at >= TIMESTAMP '{STORY_NOW}' - INTERVAL 400 DAY AND category <> 'Security'"


@R.add(f"""{news.SCORED}, {discovery._NEAR}, good AS ({_GOOD}), own AS (SELECT query_id, id, rank FROM near JOIN good ON story_id = id WHERE rank <= {search.FETCHED}),
placed AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS place FROM own QUALIFY place <= {search.KEPT}),
words AS (SELECT story_id AS id, CAST(row_number() OVER (ORDER BY importance_score DESC, published_at DESC, story_id) AS INTEGER) AS place FROM good WHERE contains(lower(topic), 'urgent') QUALIFY place <= {search.KEPT})
SELECT * FROM placed UNION ALL SELECT query_id, id, place FROM (SELECT DISTINCT query_id FROM near WHERE query_id NOT IN (SELECT query_id FROM own)) CROSS JOIN words""")
def answer_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near ones that pass the question's filters, else those with a word of it."""
    near = discovery.near(spark, sf_dir, search.FETCHED)
    passes = (F.col("published_at") >= at(STORY_NOW) - F.make_dt_interval(days=F.lit(400))) & (F.col("category") != "Security")
    return editorial.retrieved(near, news.scored(spark, sf_dir), passes, search.any_token(["urgent"], ["topic"]), search.KEPT)
