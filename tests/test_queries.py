"""Every registered query against its SQL, and those without SQL for their rows."""

import numpy as np
import pytest

import __spark_entry__ as entry
from tidemill.plans import catalog

from .support import differences
from .test_functions import plain_fnv

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    assert differences(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF) == ""


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def words_of(spark, most=None):
    """Words of each article, and its time, by plain calls of the text functions' own definitions."""
    from pyspark.sql import functions as F

    from tidemill.functions import text
    from tidemill.sources import tables

    a = tables.articles(spark, SF)
    joined = F.substring(F.concat_ws("\n\n", "title", F.when(F.trim("content") != "", F.col("content")).otherwise(F.col("title"))), 1, most) if most else F.concat_ws(" ", "title", "content")
    return {r["article_id"]: r for r in a.select("article_id", "published_at", text.normalize(joined).alias("n")).select("*", text.tokenize(F.col("n")).alias("k")).collect()}


def runs(words):
    return [" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))] if words else []


def test_simhashes_against_loops(spark):
    expected = {}
    for i, r in words_of(spark).items():
        h = [plain_fnv(s.encode(), 64) for s in runs(r["k"])]
        expected[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    got = {r["article_id"]: r["simhash"] % (1 << 64) for r in catalog.queries()["article_simhashes"](spark, SF).collect()}
    assert got == expected


def test_embeddings_against_loops(spark):
    got = {r["article_id"]: r["embedding"] for r in catalog.queries()["hashed_embeddings"](spark, SF).collect()}
    for i, r in words_of(spark, 6000).items():
        v = np.zeros(1536)
        for s, weight in [(s, 1.0) for s in runs(r["k"])] + [(s, 0.5) for s in r["k"]]:
            h = plain_fnv(s.encode(), 32)
            v[h % 1536] += -weight if h >> 31 else weight
        assert np.allclose(got[i], v / (np.linalg.norm(v) or 1), atol=1e-6)


def test_clusters_against_one_pass(spark):
    from tidemill.operators import clustering
    from tidemill.plans import discovery

    whole = clustering._assign(discovery.hashed(spark, SF).join(discovery.embedded(spark, SF), "article_id").toPandas())
    got = {r["article_id"]: (r["story_id"], r["match"]) for r in catalog.queries()["article_clusters"](spark, SF).collect()}
    assert got == {a: (s, m) for a, s, m in zip(whole["article_id"], whole["story_id"], whole["match"], strict=True)}
    assert set(whole["match"]) == {"New", "ExactHash", "NearDuplicate", "Semantic"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["topic", "period_start", "story_count", "source_count", "weighted_importance", "momentum_percent"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
