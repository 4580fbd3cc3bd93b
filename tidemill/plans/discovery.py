"""Queries that search, tag, relate and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, search_query, text, vectors
from ..operators import clustering, nearest, search, stories, story_store
from ..operators.story_store import StoryStore
from ..sources import tables as T
from ..sources.storage import new_path
from ..sources.tables import STORY_NOW, at, sql_with
from . import news
from .registry import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql

_NORM = "trim(regexp_replace(translate(strip_accents(lower(COALESCE({}, ''))), 'ığşøæßđł', 'igsoasdl'), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"
TOKENS = ["ring", "blue", "economy", "unknowntoken"]


def norm_sql(column: str) -> str:
    return _NORM.format(column)


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stories with title, dek and summary."""
    p = T.table(spark, sf_dir, "part")
    cols = p.select(
        F.col("p_partkey").alias("story_id"), F.col("p_name").alias("title"), F.col("p_type").alias("dek"), F.col("p_brand").alias("summary"), (F.col("p_size") * 2).alias("importance_score"),
        F.timestamp_seconds(F.lit(978307200) + F.col("p_partkey") * 60).alias("published_at"), F.array(F.lower("p_type")).alias("slugs"),
    )
    return cols.withColumns({f"{c}_n": text.normalize(F.col(c)) for c in ("title", "dek", "summary")})


_CATALOGUE = f"""c AS (SELECT p_partkey AS story_id, p_name AS title, p_type AS dek, p_brand AS summary, p_size * 2 AS importance_score, TIMESTAMP '2001-01-01' + p_partkey * INTERVAL 1 MINUTE AS published_at, lower(p_type) AS slug,
    {norm_sql('p_name')} AS title_n, {norm_sql('p_type')} AS dek_n, {norm_sql('p_brand')} AS summary_n FROM part)"""
_ANY = " OR ".join(f"contains(lower({c}), '{t}')" for t in TOKENS for c in ("title", "dek", "summary"))
_REL = " + ".join(f"CASE WHEN contains(slug, '{t}') THEN 5 ELSE 0 END + CASE WHEN contains(title_n, '{t}') THEN 4 WHEN contains(dek_n, '{t}') THEN 2 WHEN contains(summary_n, '{t}') THEN 1 ELSE 0 END" for t in TOKENS)


@R.add(f"WITH {_CATALOGUE}, pool AS (SELECT * FROM c WHERE {_ANY} OR slug IN ({', '.join(repr(t) for t in TOKENS)}) ORDER BY importance_score DESC, published_at DESC, story_id LIMIT {search.POOL}) SELECT story_id, CAST({_REL} AS INTEGER) AS relevance FROM pool")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_search(_catalogue(spark, sf_dir), TOKENS).select("story_id", "relevance")


@R.add(f"WITH {_CATALOGUE} SELECT story_id FROM c WHERE (contains(lower(title), 'red') OR contains(lower(dek), 'red')) AND (contains(lower(title), 'widget') OR contains(lower(dek), 'widget'))")
def all_token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue(spark, sf_dir).filter(search.all_tokens(["red", "widget"], ["title", "dek"])).select("story_id")




def _parse_sql() -> str:
    phrase = "CASE " + " ".join(f"WHEN contains(n, '{p}') THEN '{p}'" for p, _ in search_query.TIME_PHRASES) + " END"
    days = "CASE " + " ".join(f"WHEN contains(n, '{p}') THEN {d}" for p, d in search_query.TIME_PHRASES) + " END"
    blanked = "timed"
    for o in search_query.OFFICIAL:
        blanked = f"replace({blanked}, '{o}', ' ')"
    for f in search_query.FILLERS:
        blanked = f"replace({blanked}, '{f}', ' ')"
    return f"""WITH q AS (SELECT conv_id, turn, {norm_sql("text || CASE conv_id % 5 WHEN 0 THEN ' son bir ayda' WHEN 1 THEN ' last 3 months official source' WHEN 2 THEN ' haberlerini göster bugün' ELSE '' END")} AS n FROM conversations),
p AS (SELECT *, {phrase} AS phrase, {days} AS days, contains(n, 'resmi kaynak') OR contains(n, 'official source') AS official_only FROM q),
t AS (SELECT *, CASE WHEN phrase IS NULL THEN n ELSE replace(n, phrase, ' ') END AS timed FROM p),
l AS (SELECT *, trim(regexp_replace({blanked}, ' +', ' ', 'g')) AS left_ FROM t)
SELECT conv_id, turn, CASE WHEN left_ = '' THEN n ELSE left_ END AS text, days, official_only FROM l"""


@R.add(_parse_sql())
def parsed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.when(F.col("conv_id") % 5 == 0, " son bir ayda").when(F.col("conv_id") % 5 == 1, " last 3 months official source").when(F.col("conv_id") % 5 == 2, " haberlerini göster bugün").otherwise("")
    c = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize(F.concat("text", extra)).alias("n"))
    return c.select("conv_id", "turn", search_query.parse(F.col("n")).alias("q")).select("conv_id", "turn", "q.*")


_COS = "COALESCE(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 0.0)"
_NEAR = f"near AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {_COS.format(a='v.embedding', b='q.embedding')} AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS.format(a='v.embedding', b='q.embedding')} DESC, v.vec_id) AS INTEGER) AS rank FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)"


def near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    v = T.table(spark, sf_dir, "embeddings")
    return nearest.nearest(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), k)


@R.add(f"WITH {_NEAR} SELECT query_id, rank, id, round(similarity, 6) AS similarity FROM near WHERE rank <= 5")
def nearest_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, sf_dir, 5).withColumn("similarity", F.round("similarity", 6))


@R.add(f"""{sql_with('stories')}, {_NEAR}, f AS (SELECT near.*, published_at FROM near JOIN stories ON story_id = id WHERE rank <= {search.FETCHED} AND published_at >= TIMESTAMP '{STORY_NOW}' - INTERVAL 1500 DAY)
SELECT query_id, id, rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS place FROM f QUALIFY place <= {search.KEPT}""")
def answer_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = at(STORY_NOW) - F.make_dt_interval(days=F.lit(1500))
    return search.passages(near(spark, sf_dir, search.FETCHED), T.stories(spark, sf_dir), since).select("query_id", "id", "rank", "place")


_OVERLAP = f"""{news._TOPICS}, own AS (SELECT story_id AS query_id, topic_id FROM story_topics WHERE story_id % 50 = 0),
shared AS (SELECT query_id, story_id AS id, count(*) AS shared FROM story_topics JOIN own USING (topic_id) WHERE story_id <> query_id GROUP BY ALL),
ranked AS (SELECT query_id, id, shared, CAST(row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, importance DESC, id) AS INTEGER) AS rank FROM shared JOIN stories ON stories.story_id = id)"""


def _overlap(spark: SparkSession, sf_dir: str, shown: str = "true") -> DataFrame:
    s = T.stories(spark, sf_dir)
    topics = stories.topics(T.story_members(spark, sf_dir))
    return search.topic_overlap(topics, s.filter("story_id % 50 = 0").select(F.col("story_id").alias("query_id")), s.filter(shown).select("story_id", F.col("importance").alias("importance_score")))


@R.add(f"{sql_with('story_members', 'stories')}, {_OVERLAP} SELECT query_id, rank, id, shared FROM ranked WHERE rank <= 5")
def topic_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir)


_SHOWN = _OVERLAP.replace("ON stories.story_id = id)", "ON stories.story_id = id WHERE status = 'Published')")


@R.add(f"""{sql_with('story_members', 'stories')}, {_SHOWN}, {_NEAR}, n AS (SELECT query_id, id FROM near WHERE rank <= 5)
SELECT query_id, id FROM n JOIN stories ON story_id = id WHERE status = 'Published' UNION ALL SELECT query_id, id FROM ranked WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM n)""")
def related_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = T.stories(spark, sf_dir).filter("status = 'Published'")
    return search.related(near(spark, sf_dir, 5), _overlap(spark, sf_dir, "status = 'Published'"), published)


TERMS = [("widgets", "widget"), ("widgets", "ring"), ("colours", "red"), ("colours", "blue bolt"), ("brands", "brand 17"), ("sizes", "economy"), ("sizes", "x"), ("brands", "brand 2")]
_TERMS = "terms AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TERMS) + ") t(slug, term) WHERE length(term) >= 2)"


@R.add(f"""WITH {_CATALOGUE}, {_TERMS}, b AS (SELECT *, {norm_sql("title || ' ' || dek || ' ' || summary")} AS body_n FROM c)
SELECT story_id AS id, terms.slug AS slug, max(CASE WHEN contains(' ' || title_n || ' ', ' ' || term || ' ') THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) AS weight FROM b JOIN terms ON contains(' ' || title_n || ' ', ' ' || term || ' ') OR contains(' ' || body_n || ' ', ' ' || term || ' ') GROUP BY ALL""")
def topic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalogue(spark, sf_dir)
    texts = c.select(F.col("story_id").alias("id"), "title_n", text.normalize(F.concat_ws(" ", "title", "dek", "summary")).alias("body_n"))
    return search.topic_matches(texts, spark.createDataFrame(TERMS, "slug string, term string"))


@R.add("""WITH s AS (SELECT p_partkey AS id, lower(p_type) AS slug FROM part WHERE p_size > 40), m AS (SELECT p_partkey AS id, lower(p_type) AS slug, 0.6 AS weight FROM part WHERE p_size % 2 = 0)
SELECT id, slug, CAST(max(weight) AS DOUBLE) AS weight FROM (SELECT id, slug, 1.0 AS weight FROM s UNION ALL FROM m) GROUP BY ALL""")
def merged_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_type").alias("slug"), "p_size")
    return search.merged_tags(p.filter("p_size > 40"), p.filter("p_size % 2 = 0").withColumn("weight", F.lit(0.6)))


@R.add("""WITH l AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM l GROUP BY ALL)
SELECT label, list(round(m, 5) + 0.0 ORDER BY i) AS centroid FROM m GROUP BY label""")
def topic_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors.centroid(T.table(spark, sf_dir, "embeddings"), ["label"], "embedding", kind="double")
    return c.select("label", F.transform("centroid", lambda x: F.round(x, 5)).alias("centroid"))


def hashed(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Articles with normal form, content hash and SimHash, and ``more`` columns."""
    made = lambda n: F.struct(text.content_hash(n).alias("content_hash"), F.array_join(text.tokenize(n), " ").alias("words"))
    a = T.articles(spark, sf_dir).withColumn("h", text.let(text.normalize(F.concat_ws(" ", "title", "content")), made))
    return a.select("article_id", "source", "published_at", "h.content_hash", hashing.simhash(F.col("h.words")).alias("simhash"), *more)


@R.add(f"{sql_with('articles')} SELECT article_id, upper(sha256({norm_sql(chr(39).join(['concat_ws(', ' ', ', title, content)']))})) AS content_hash FROM articles")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.articles(spark, sf_dir)
    return a.select("article_id", text.content_hash(text.normalize(F.concat_ws(" ", "title", "content"))).alias("content_hash"))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_BYTES = "list_transform(range(0, octet_length(encode(x))), lambda i: CAST('0x' || substr(hex(encode(x)), 2 * i + 1, 2) AS HUGEINT))"


@R.add(f"""{sql_with('articles')}, n AS (SELECT article_id, {norm_sql("concat_ws(' ', title, content)")} AS n FROM articles),
k AS (SELECT article_id, list_filter(string_split(n, ' '), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t)) AS k FROM n),
u AS (SELECT article_id, unnest(CASE WHEN len(k) = 1 THEN k ELSE list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]) END) AS x FROM k),
h AS (SELECT x, list_reduce({_BYTES}, lambda a, b: (xor(a, b) * {hashing.PRIME_64}) % 18446744073709551616, {hashing.BASIS_64}::HUGEINT) AS h FROM (SELECT DISTINCT x FROM u)),
v AS (SELECT article_id, b, count(*) AS n, sum(CAST((h // CAST(pow(2::DOUBLE, b) AS HUGEINT)) % 2 AS INTEGER)) AS ones FROM u JOIN h USING (x) CROSS JOIN (SELECT unnest(range(64)) AS b) GROUP BY ALL),
m AS (SELECT article_id, sum(CASE WHEN 2 * ones > n THEN CASE b WHEN 63 THEN -9223372036854775808::HUGEINT ELSE CAST(pow(2::DOUBLE, b) AS HUGEINT) END ELSE 0 END) AS s FROM v GROUP BY article_id)
SELECT article_id, CAST(COALESCE(s, 0) AS BIGINT) AS simhash FROM articles LEFT JOIN m USING (article_id)""")
def article_simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(spark, sf_dir).select("article_id", "simhash")


def embedding() -> Column:
    """Of an article's whole title and content."""
    normal = text.normalize(F.concat_ws("\n\n", "title", text.best_text(F.col("content"), F.lit(None).cast("string"), F.col("title"))))
    words = text.let(normal, lambda n: F.array_join(text.tokenize(n), " "))
    return hashing.hashed_embedding(words)


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.articles(spark, sf_dir).select("article_id", embedding().alias("embedding"))


@R.add()
def article_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings are those of ``hashed_embeddings``."""
    return clustering.cluster(hashed(spark, sf_dir, embedding().alias("embedding")))


#: Minutes between articles of the stored stories, so that stories close; batches that they come in.
_APART, _BATCHES = 40, 5


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = F.timestamp_seconds(F.unix_timestamp(at("2024-01-01 00:00:00")) + F.col("article_id") * 60 * _APART)
    return hashed(spark, sf_dir).withColumns({"published_at": published, "embedding": F.lit(None).cast("array<float>")})


_OPEN = "STRUCT(id BIGINT, s BIGINT, since TIMESTAMP, last TIMESTAMP, held VARCHAR[])"
_BITS_APART = "bit_count(xor(s, o.s))"
# one article a step; a step holds the stories that were active in the 72 hours before
_GREEDY = f"""hashed AS ({SQL['content_hashes']}), simhashed AS ({SQL['article_simhashes']}),
a AS MATERIALIZED (SELECT article_id, content_hash AS h, simhash AS s, TIMESTAMP '2024-01-01' + article_id * INTERVAL {_APART} MINUTE AS t, row_number() OVER (ORDER BY article_id) AS k FROM hashed JOIN simhashed USING (article_id)),
g AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS article_id, NULL::VARCHAR AS h, NULL::TIMESTAMP AS t, NULL::BIGINT AS story_id, NULL::VARCHAR AS match, NULL::DOUBLE AS similarity, []::{_OPEN}[] AS stories
UNION ALL SELECT k, article_id, h, t, CASE WHEN pick IS NULL THEN article_id ELSE live[pick].id END, CASE WHEN same IS NOT NULL THEN 'ExactHash' WHEN pick IS NOT NULL THEN 'NearDuplicate' ELSE 'New' END,
    CASE WHEN same IS NOT NULL THEN 1.0 WHEN pick IS NOT NULL THEN 1 - near.d / 64.0 ELSE 0.0 END,
    CASE WHEN pick IS NULL THEN list_append(live, {{'id': article_id, 's': s, 'since': t, 'last': t, 'held': [h]}}::{_OPEN})
        ELSE list_transform(live, lambda o, i: CASE WHEN i = pick THEN {{'id': o.id, 's': o.s, 'since': o.since, 'last': t, 'held': list_append(o.held, h)}}::{_OPEN} ELSE o END) END
  FROM (SELECT *, COALESCE(same, near.i) AS pick FROM (SELECT *, list_filter(list_transform(live, lambda o, i: CASE WHEN list_contains(o.held, h) THEN i END), lambda i: i IS NOT NULL)[1] AS same,
      list_sort(list_filter(list_transform(live, lambda o, i: {{'d': {_BITS_APART}, 'i': CASE WHEN s <> 0 AND o.s <> 0 AND {_BITS_APART} <= {hashing.NEAR_BITS} THEN i END}}), lambda x: x.i IS NOT NULL))[1] AS near
    FROM (SELECT a.*, list_filter(g.stories, lambda o: a.t - o.last <= INTERVAL 72 HOUR) AS live FROM g JOIN a ON a.k = g.k + 1))))"""


def _in_batches(spark: SparkSession, sf_dir: str) -> StoryStore:
    store = StoryStore(spark, new_path(spark, "story-store"))
    story_store.cluster_periods(store, _spread(spark, sf_dir), _BATCHES)
    return store


@R.add(f"WITH RECURSIVE {_GREEDY} SELECT article_id, story_id, match, CAST(similarity AS DOUBLE) AS similarity FROM g WHERE k > 0")
def clustered_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that come in batches and meet the stories of earlier ones, by content hash and SimHash."""
    return _in_batches(spark, sf_dir).read("assigned").select("article_id", "story_id", "match", "similarity")


@R.add(f"WITH RECURSIVE {_GREEDY} SELECT story_id, min(t) AS published_at, max(t) AS last_activity_at, count(DISTINCT h) AS n_hashes FROM g WHERE k > 0 GROUP BY story_id")
def story_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored stories are after the last batch."""
    return story_store.states(_in_batches(spark, sf_dir))


@R.add()
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir)
