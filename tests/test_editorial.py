"""Ties and rounds of the newsroom's steps."""

import datetime as dt
import re

from pyspark.sql import functions as F

from tidemill.functions.text import slugify_unique
from tidemill.operators import editorial, stories
from tidemill.plans import newsroom
from tidemill.sources.storage import stored

T = dt.datetime(2024, 1, 1)
MEMBERS = "story_id long, position int, source_id long, published_at timestamp, body string"


def test_members_with_one_time_and_position(spark):
    rows = [(1, 1, s, T, f"body {s}") for s in (7, 3, 9, 5)] + [(2, 1, 3, T, "only")]
    sources = spark.createDataFrame([(s, f"n{s}", s == 5, 0.5) for s in (3, 5, 7)], "source_id long, name string, is_official boolean, trust_weight double")
    for order in (rows, rows[::-1]):
        m = spark.createDataFrame(order, MEMBERS).repartition(3)
        primary = stories.primary(m, sources)
        got = {r["story_id"]: r for r in editorial.prompt_contexts(m, sources, primary).collect()}
        assert got[1]["excerpts"] == ["body 5", "body 3", "body 7", "body 9"] and got[1]["source_names"] == ["n5", "n3", "n7", "Bilinmeyen kaynak"]
        page = editorial.details(m.select("story_id").distinct(), m, sources, primary, m.select("story_id", "position", F.lit("u").alias("url")), m.select("story_id", F.lit(1).cast("long").alias("topic_id"), F.lit(0.5).alias("weight")).distinct())
        assert [s["name"] for s in {r["story_id"]: r for r in page.collect()}[1]["sources"]] == ["n5", "n3", "n7", "Bilinmeyen kaynak"]


def test_slugs_until_none_is_lost(spark):
    rows = [(i, "same title", f"{i % 2:08d}") for i in range(40)] + [(100, "free", "00000009")]
    df = spark.createDataFrame(rows, "story_id long, title_n string, hex_id string")
    taken = df.filter("story_id < 2").select(slugify_unique(F.col("title_n"), F.col("hex_id")).alias("slug"))
    got = {r["story_id"]: r["slug"] for r in editorial.unique_slugs(df, taken).collect()}
    assert len(set(got.values())) == len(got) == len(rows) and got[100] == "free-00000009"
    assert not {r["slug"] for r in taken.collect()} & set(got.values())
    last = editorial.unique_slugs(df, taken, attempts=0)  # no attempt: losers keep their whole id
    assert {r["slug"] for r in last.filter("story_id < 40").collect()} == {"00000000", "00000001"}
    assert editorial.unique_slugs(df.filter("story_id = 100"), taken)._jdf.queryExecution().toString().count("FileScan parquet") <= 12


def test_nothing_to_slug(spark):
    df = spark.createDataFrame([], "story_id long, title_n string, hex_id string")
    assert editorial.unique_slugs(df, df.select(F.col("title_n").alias("slug"))).count() == 0


def test_members_are_shuffled_once_for_counts(spark):
    rows = [(1, 1, 7, T, 2), (1, 2, 7, T + dt.timedelta(days=1), None), (1, 3, 5, T, 4), (1, 4, None, T, 8), (1, 5, 9, T, 1), (2, 1, None, T, None)]
    m = spark.createDataFrame(rows, "story_id long, position int, source_id long, published_at timestamp, engagement_score int")
    sources = stored(spark.createDataFrame([(5, True, 0.25), (7, False, 0.75)], "source_id long, is_official boolean, trust_weight double"), "sources")
    made = stories.aggregates(m, sources)
    assert {r[0]: tuple(r)[1:] for r in made.collect()} == {1: (3, 1, 0.75, 15, T, T + dt.timedelta(days=1)), 2: (0, 0, 0.5, 0, T, T)}
    plan = stories.aggregates(m, sources)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning(story_id") == 1


def test_what_a_reader_wants_is_gathered_by_topic(spark, monkeypatch):
    """A row for each reader is what is stored, before any story of the pool is laid beside it."""
    from tidemill.operators import scoring

    tables = []
    monkeypatch.setattr(scoring, "stored", lambda df, name: tables.append(df) or df)
    pool = spark.createDataFrame([(s, "Ai", 3, 50, 50, 1) for s in range(1, 6)], "story_id long, category string, reading_minutes int, importance_score int, trust_score int, primary_source_id long")
    topics = spark.createDataFrame([(s, t, 0.5 * s) for s in range(1, 5) for t in (1, 2, s + 10)], "story_id long, topic_id long, weight double")
    readers = spark.createDataFrame([(u,) for u in (1, 2, 3)], "user_id long")
    interests = spark.createDataFrame([(1, 1, 0.5), (1, 2, 2.0), (1, 12, 0.1), (2, 14, 0.4), (2, 99, 1.0)], "user_id long, topic_id long, weight double")
    muted = spark.createDataFrame([(2, 12), (3, 1)], "user_id long, topic_id long")
    none = spark.createDataFrame([], "user_id long, story_id long")
    got = {(r["user_id"], r["story_id"]): r["score"] for r in scoring.personal(pool, readers, topics, interests, muted, none.withColumnRenamed("story_id", "source_id"), none).collect()}
    likes = {(1, 1): 0.5 + 0.07, (1, 2): 1.0, (1, 3): 1.0, (1, 4): 1.0, (2, 4): 0.4}
    shown = [(1, s) for s in range(1, 6)] + [(2, s) for s in (1, 3, 4, 5)] + [(3, 5)]
    assert got == {k: round(0.45 * 50 + 35 * likes.get(k, 0), 4) for k in shown}
    assert [t.count() for t in tables] == [3] and {"wanted", "unwanted"} <= set(tables[0].columns)


def test_bodies_are_cut_and_parted_before_they_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(editorial, "PART", 16)
    rows = [(i // 8, i % 8, 3, T, f"{i} " + "x" * 3000) for i in range(160)]
    m = spark.createDataFrame(rows, MEMBERS)
    sources = stored(spark.createDataFrame([(3, "n3", True, 0.5)], "source_id long, name string, is_official boolean, trust_weight double"), "sources")
    made = editorial.prompt_contexts(m, sources, stored(stories.primary(m, sources), "primaries"))
    shuffled = made._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(story_id")
    assert "10), REPARTITION_BY_NUM" in shuffled[1] and "substring" not in shuffled[0] and "substring(body" in shuffled[1]
    got = {r["story_id"]: r["excerpts"] for r in made.collect()}
    assert got == {s: [f"{8 * s + k} ".ljust(2500, "x") for k in range(6)] for s in range(20)}


def test_refreshed_stories_shuffle_members_once(spark):
    """One shuffle of members by story for all counts and one for their vectors, and one join with sources."""
    plan = newsroom.refreshed_stories(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and len(re.findall(r"Relation \[l_orderkey", plan)) == 2 and len(re.findall(r"Relation \[s_suppkey", plan)) == 1


def test_refreshed_with_odd_members(spark):
    rows = [(1, 1, 3, T, 5, False), (1, 2, 5, T, None, False), (1, 3, None, T, 2, False), (2, 2, 9, T, 4, True), (2, 1, 5, T, 1, False), (3, 1, 3, None, 7, None), (9, 1, 3, T, 1, False)]
    m = spark.createDataFrame(rows, "story_id long, position int, source_id long, published_at timestamp, engagement_score int, is_primary boolean")
    sources = spark.createDataFrame([(3, "n3", False, 0.25), (3, "n3", False, 0.5), (5, "n5", True, 0.75)], "source_id long, name string, is_official boolean, trust_weight double")
    s = spark.createDataFrame([(1, "Published"), (2, "Draft"), (3, "Published"), (4, "Published")], "story_id long, status string")
    v = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, None), (2, []), (3, [1.0]), (3, [1.0, 2.0])], "story_id long, embedding array<float>")
    got = {r["story_id"]: r for r in editorial.refreshed(s, m, sources, v).collect()}
    names = "status", "primary_position", "distinct_source_count", "official_source_count", "max_trust_weight", "engagement", "first_published_at", "last_activity_at", "embedding"
    assert {k: tuple(r[n] for n in names) for k, r in got.items()} == {
        1: ("Enriching", 2, 2, 1, 0.75, 12, T, T, [2.0, 3.0]),  # 5 twice, as its source has two rows
        2: ("Draft", 2, 2, 1, 0.75, 5, T, T, None),
        3: ("Published", 1, 1, 0, 0.5, 14, None, None, None),
    }
    old = stories.aggregates(m, sources).drop("_n").collect()
    assert all(r[c] == got[r["story_id"]][c] for r in old if r["story_id"] in got for c in r.asDict())
