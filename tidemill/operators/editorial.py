"""Newsroom steps: story search, prompt contexts, queues, refreshed stories, unique slugs, digests, profiles, learning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slugify_unique
from ..functions.vectors import centroid
from ..sources.storage import stored
from . import stories as S

PROMPT_ARTICLES, PROMPT_CHARS, LEARNING_DAYS, LEARNING_STORIES = 6, 2500, 7, 25
#: Members of a part, so that its excerpts are sorted in memory.
PART = 40_000
UNKNOWN_SOURCE = "Bilinmeyen kaynak"
#: Given where a reader has no such row.
PROFILE = {"experience_level": "Mid", "digest_hour": 8, "story_count": 10, "learning_minutes": 15}
STREAK = {"current": 0, "longest": 0, "weekly_goal_days": 5}


def searched(stories: DataFrame, story_topics: DataFrame | None = None, since: Column | None = None, until: Column | None = None, category: str | None = None, min_trust: int | None = None, official_only: bool = False, topic_ids: list[int] | None = None) -> DataFrame:
    """Published stories that pass all given filters: times inclusive, least trust, an official source, any of the topics."""
    out = stories.filter("status = 'Published'")
    for given, keep in ((since, lambda: F.col("published_at") >= since), (until, lambda: F.col("published_at") <= until), (category, lambda: F.col("category") == category), (min_trust, lambda: F.col("trust_score") >= min_trust)):
        if given is not None:
            out = out.filter(keep())
    if official_only:
        out = out.filter("official_source_count > 0")
    if topic_ids:
        out = out.join(story_topics.filter(F.col("topic_id").isin(topic_ids)), "story_id", "left_semi")
    return out


def asked(filters: DataFrame, stories: DataFrame, now: Column) -> DataFrame:
    """(days, official_only, n, latest) for each distinct parsed filter: the published stories that pass it. Filters are
    few: a period of the fixed phrases or none, with or without official sources."""
    from_ = now - F.make_dt_interval(days=F.col("days"))
    kinds = filters.select("days", "official_only").distinct()
    passes = (F.col("days").isNull() | (F.col("published_at") >= from_)) & (~F.col("official_only") | (F.col("official_source_count") > 0))
    found = stories.filter("status = 'Published'").join(kinds, passes)
    counts = found.groupBy("days", "official_only").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("published_at", "story_id"))["story_id"].alias("latest"))
    k, c = kinds.alias("k"), counts.alias("c")
    same = F.col("k.days").eqNullSafe(F.col("c.days")) & (F.col("k.official_only") == F.col("c.official_only"))
    return k.join(c, same, "left").select("k.days", "k.official_only", F.coalesce("n", F.lit(0)).alias("n"), "latest")


def personal_note(notes: Column, slugs: Column) -> Column:
    """The note (map of slug to note) of the first slug that has one which isn't blank."""
    return F.try_element_at(F.filter(F.transform(slugs, lambda s: F.try_element_at(notes, s)), lambda n: n.rlike(r"\S")), F.lit(1))


def _sourced(members: DataFrame, sources: DataFrame, primaries: DataFrame) -> DataFrame:
    """Members with name and kind of their source, and ``_first``: whether one is the story's primary. Two members may
    share a position, so the primary is told by its source as well."""
    p = primaries.select("story_id", F.col("position").alias("_p"), F.col("primary_source_id").alias("_s"))
    j = members.join(sources.select("source_id", "name", "is_official"), "source_id", "left").join(p, "story_id", "left")
    return j.withColumn("_first", F.coalesce((F.col("position") == F.col("_p")) & F.col("source_id").eqNullSafe(F.col("_s")), F.lit(False)))


def prompt_contexts(members: DataFrame, sources: DataFrame, primaries: DataFrame) -> DataFrame:
    """(story_id, excerpts, source_names): PROMPT_ARTICLES members, primary first, then official ones, then by time, position
    and source; the first PROMPT_CHARS characters of each, and the distinct source names. ``members``: story_id, position,
    source_id, published_at, body.

    Bodies are cut before they are shuffled, once, to parts of about PART members. Spark sizes parts by compressed bytes, and
    texts may be many times those, so that each sort of a part would spill."""
    cut = members.withColumn("body", F.substring("body", 1, PROMPT_CHARS))
    j = _sourced(cut.repartition(max(1, -(-members.count() // PART)), "story_id"), sources, primaries)
    order = [F.col("_first").desc(), F.coalesce("is_official", F.lit(False)).desc(), F.col("published_at"), F.col("position"), F.col("source_id")]
    first = j.withColumn("_k", F.row_number().over(Window.partitionBy("story_id").orderBy(*order))).filter(F.col("_k") <= PROMPT_ARTICLES)
    one = F.struct("_k", F.col("body").alias("x"), F.coalesce("name", F.lit(UNKNOWN_SOURCE)).alias("s"))
    listed = first.groupBy("story_id").agg(F.array_sort(F.collect_list(one)).alias("a"))
    return listed.select("story_id", F.transform("a", lambda r: r["x"]).alias("excerpts"), F.array_distinct(F.transform("a", lambda r: r["s"])).alias("source_names"))


def queue(df: DataFrame, waiting: Column, order: list[Column], size: int, most: int) -> DataFrame:
    """The next ``size`` (held between 1 and ``most``) rows of those waiting."""
    return df.filter(waiting).orderBy(*order).limit(min(max(size, 1), most))


def refreshed(stories: DataFrame, members: DataFrame, sources: DataFrame, vectors: DataFrame) -> DataFrame:
    """(story_id, status, counts, times, embedding, primary_position) after new coverage. ``members``: story_id, position,
    source_id, published_at, engagement_score, is_primary; ``vectors``: story_id, embedding (nullable) of its members. A
    primary member stays; without any the official, then earliest one becomes it. A published story with several members
    goes back to Enriching; a story without members is unchanged and not in the result.

    Members meet their sources first and are shuffled by story once, for all that is counted of them; vectors are shuffled
    whole, as a story has few."""
    known = sources.groupBy("source_id").agg(F.max("is_official").alias("is_official"), F.max("trust_weight").alias("trust_weight"), F.count(F.lit(1)).alias("_n"))
    t = F.col("published_at")
    j = members.join(known, "source_id", "left").select(
        "story_id", "source_id", "is_official", "trust_weight", t, F.when(F.col("is_primary"), F.col("position")).alias("_given"), "position",
        (F.coalesce("engagement_score", F.lit(0)) * F.coalesce("_n", F.lit(1))).alias("_e"),
    )
    first = F.struct((~F.coalesce("is_official", F.lit(False))).alias("o"), t.alias("t"), F.col("position").alias("position"))
    each = j.repartition("story_id").groupBy("story_id", "source_id").agg(
        F.sum("_e").alias("_e"), F.min(t).alias("_from"), F.max(t).alias("_to"), F.count(F.lit(1)).alias("_n"), F.max("is_official").alias("is_official"), F.max("trust_weight").alias("trust_weight"), F.min("_given").alias("_given"), F.min(first).alias("_f"),
    )
    summed = each.groupBy("story_id").agg(
        F.count("source_id").cast("int").alias("distinct_source_count"), F.count_if("is_official").cast("int").alias("official_source_count"), F.coalesce(F.max("trust_weight"), F.lit(0.5)).alias("max_trust_weight"), F.sum("_e").alias("engagement"),
        F.min("_from").alias("first_published_at"), F.max("_to").alias("last_activity_at"), F.sum("_n").alias("_n"), F.coalesce(F.min("_given"), F.min("_f")["position"]).alias("primary_position"),
    )
    mean = centroid(vectors.filter(F.size("embedding") > 0).repartition("story_id"), ["story_id"], "embedding", "embedding")
    out = stories.select("story_id", "status").join(summed, "story_id").join(mean, "story_id", "left")
    status = F.when((F.col("status") == "Published") & (F.col("_n") > 1), "Enriching").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("_n")


def enriched(stories: DataFrame, results: DataFrame) -> DataFrame:
    """(story_id, status, published, failed): Draft and Enriching stories that were tried are Published if it went well and
    Enriching if not; others keep their status. ``results``: story_id, ok."""
    j = stories.select("story_id", "status").join(results.select("story_id", "ok"), "story_id", "left")
    tried = F.col("ok").isNotNull() & F.col("status").isin("Draft", "Enriching")
    return j.select("story_id", F.when(tried, F.when(F.col("ok"), "Published").otherwise("Enriching")).otherwise(F.col("status")).alias("status"), (tried & F.col("ok")).alias("published"), (tried & ~F.col("ok")).alias("failed"))


def reroll(key: Column, attempt: int) -> Column:
    """Hex digits for one more attempt at a slug, from the key alone, so that reruns agree."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(attempt))).cast("binary"))


def unique_slugs(stories: DataFrame, taken: DataFrame, attempts: int = 5) -> DataFrame:
    """(story_id, slug) of story_id, title_n and hex_id: slugs that are taken or that a story with a smaller id has get
    another suffix, ``attempts`` times, and then the whole id. ``taken``: slug.

    Each round is a table, and the next one has its losers only, which are few; of the slugs in use it takes those that
    meet the losers'. It ends when there are no losers."""
    left = stories.withColumn("slug", slugify_unique(F.col("title_n"), F.col("hex_id")))
    used, settled = [taken.select("slug")], []
    for k in range(attempts + 1):
        met = reduce(DataFrame.unionByName, used).join(left.select("slug"), "slug", "left_semi").distinct().withColumn("_t", F.lit(True))
        order = Window.partitionBy("slug").orderBy(F.col("_t").asc_nulls_first(), "story_id")
        lost = F.coalesce(F.col("_t"), F.lit(False)) | (F.row_number().over(order) > 1)
        ranked = stored(left.join(met, "slug", "left").withColumn("_lost", lost).drop("_t"), "slugs")
        settled.append(ranked.filter("NOT _lost").select("story_id", "slug"))
        used.append(ranked.filter("NOT _lost").select("slug"))
        losers = ranked.filter("_lost").select(*stories.columns)
        if losers.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        left = losers.withColumn("slug", slugify_unique(F.col("title_n"), reroll(F.col("story_id"), k + 1)))
    return reduce(DataFrame.unionByName, settled).unionByName(losers.select("story_id", F.col("hex_id").alias("slug")))


def replaced_digests(existing: DataFrame, new: DataFrame, keys: list[str], force: Column) -> DataFrame:
    """Digest rows after a run: a key's existing rows stay unless ``force`` holds for it, and then the new ones replace
    them; keys without any get the new ones."""
    has = existing.select(*keys).distinct()
    fresh = new.select(*keys).distinct()
    kept = existing.join(fresh.filter(force), keys, "left_anti")
    added = new.filter(force).unionByName(new.filter(~force).join(has, keys, "left_anti"))
    return kept.select(*new.columns).unionByName(added)


def validated(log: DataFrame, ranges: dict[str, tuple[int, int]], lengths: dict[str, int] | None = None) -> DataFrame:
    """Log rows with ``errors``, the columns that are out of their inclusive range or too long; nulls pass."""
    bad = [F.when(~F.col(c).between(low, high), c) for c, (low, high) in ranges.items()] + [F.when(F.length(c) > most, c) for c, most in (lengths or {}).items()]
    return log.withColumn("errors", F.array_compact(F.array(*bad)))


def appended(log: DataFrame, rows: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """The log and those of ``rows`` without errors."""
    return log.unionByName(validated(rows, ranges).filter(F.size("errors") == 0).select(*log.columns))


def unmuted_interests(interests: DataFrame, mute_log: DataFrame) -> DataFrame:
    """Interests without the topics that a reader has muted, an odd number of times."""
    muted = mute_log.groupBy("user_id", "topic_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") % 2 == 1)
    return interests.join(muted, ["user_id", "topic_id"], "left_anti")


def chosen_topics(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """(user_id, topic_id, weight, is_explicit) of requested slugs (trimmed, lower case, each once); unknown ones go."""
    slugs = requests.select("user_id", F.explode("slugs").alias("s")).select("user_id", F.lower(F.trim("s")).alias("slug")).distinct()
    return slugs.join(topics.select("topic_id", "slug"), "slug").select("user_id", "topic_id", F.lit(1.0).alias("weight"), F.lit(True).alias("is_explicit"))


def learning(log: DataFrame) -> DataFrame:
    """(user_id, suggestion_id, status, completed_at, completions): last status, last time it was set to Completed, and how
    often it became so from another status. ``log``: user_id, suggestion_id, status, at, seq."""
    w = Window.partitionBy("user_id", "suggestion_id").orderBy("at", "seq")
    done = F.col("status") == "Completed"
    marked = log.withColumn("_first", done & ~F.coalesce(F.lag("status").over(w) == "Completed", F.lit(False)))
    return marked.groupBy("user_id", "suggestion_id").agg(F.max(F.struct("at", "seq", "status"))["status"].alias("status"), F.max(F.when(done, F.col("at"))).alias("completed_at"), F.count_if("_first").alias("completions"))


def once_daily(suggestions: DataFrame, local_date: Column) -> DataFrame:
    """(user_id, day, suggestion_id, position, resource): the first suggestion of each reader and local day, with its
    resources numbered from 1. Reads user_id, suggestion_id, at, resources."""
    days = suggestions.withColumn("day", local_date)
    first = days.groupBy("user_id", "day").agg(F.min(F.struct("at", "suggestion_id", "resources")).alias("f"))
    return first.select("user_id", "day", F.col("f.suggestion_id").alias("suggestion_id"), F.posexplode_outer("f.resources").alias("p", "resource")).select("user_id", "day", "suggestion_id", (F.col("p") + 1).alias("position"), "resource")


def history(suggestions: DataFrame, local_date: Column, today: Column) -> DataFrame:
    """Suggestions but for those of today by the reader's calendar, which are on screen already; with their ``day``."""
    return suggestions.withColumn("day", local_date).filter(F.col("day") != today)


def learning_context(stories: DataFrame, now: Column) -> DataFrame:
    """The most important published stories of the last days."""
    recent = stories.filter((F.col("status") == "Published") & (F.col("published_at") >= now - F.make_dt_interval(days=F.lit(LEARNING_DAYS))))
    return recent.orderBy(F.desc("importance_score"), "story_id").limit(LEARNING_STORIES)


def profiles(users: DataFrame, settings: DataFrame, interests: DataFrame, streaks: DataFrame) -> DataFrame:
    """Users with settings and streaks, defaults where they have none, and topics of interest, strongest first."""
    listed = interests.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "topic_id"))), lambda x: x["topic_id"]).alias("topic_ids"))
    j = users.join(settings, "user_id", "left").join(listed, "user_id", "left").join(streaks, "user_id", "left")
    given = [F.coalesce(F.col(c) if c in j.columns else F.lit(None), F.lit(v)).alias(c) for c, v in {**PROFILE, **STREAK}.items()]
    return j.select(*users.columns, *given, F.coalesce("topic_ids", F.array().cast("array<long>")).alias("topic_ids"))


def details(stories: DataFrame, members: DataFrame, sources: DataFrame, primaries: DataFrame, links: DataFrame, topics: DataFrame) -> DataFrame:
    """Stories with nested ``sources`` (primary first, then by time, position and source; missing ones labelled),
    ``links`` by position and ``topics`` by weight."""
    j = _sourced(members, sources, primaries)
    source = F.struct((~F.col("_first")).alias("later"), F.col("published_at").alias("t"), F.col("position").alias("p"), F.col("source_id").alias("s"), F.coalesce("name", F.lit(UNKNOWN_SOURCE)).alias("name"), F.coalesce("is_official", F.lit(False)).alias("official"))
    s = j.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(source)), lambda x: F.struct(x["name"].alias("name"), x["official"].alias("is_official"))).alias("sources"))
    k = links.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "url"))), lambda x: x["url"]).alias("links"))
    t = topics.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "topic_id"))), lambda x: x["topic_id"]).alias("topics"))
    j = stories.join(s, "story_id", "left").join(k, "story_id", "left").join(t, "story_id", "left")
    return j.withColumns({"links": F.coalesce("links", F.array().cast("array<string>")), "topics": F.coalesce("topics", F.array().cast("array<long>"))})


def shuffled(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Rows in an order that only the seed and the key decide."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary")), key)


def retrieved(near: DataFrame, stories: DataFrame, passes: Column, fallback: Column, kept: int) -> DataFrame:
    """(query_id, id, place) for an answer: of the near ones (query_id, id, rank) the published that pass the filters, by
    similarity; for a query without any, the stories that ``fallback`` finds, by importance and time. The fallback's rows
    are cut to ``kept`` before any join, as it doesn't depend on the query."""
    good = stories.filter((F.col("status") == "Published") & passes)
    own = near.join(good.select(F.col("story_id").alias("id")), "id")
    placed = own.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("place") <= kept)
    words = good.filter(fallback).orderBy(F.desc("importance_score"), F.desc("published_at"), "story_id").limit(kept)
    words = words.select(F.col("story_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("importance_score"), F.desc("published_at"), "story_id")).alias("place"))
    without = near.select("query_id").distinct().join(own.select("query_id").distinct(), "query_id", "left_anti")
    return placed.select("query_id", "id", "place").unionByName(without.join(F.broadcast(words)).select("query_id", "id", "place"))
