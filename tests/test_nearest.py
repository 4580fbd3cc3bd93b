"""Nearest neighbours against all pairs."""

import numpy as np
import pytest

from tidemill.operators.nearest import nearest
from tidemill.plans import discovery


def brute(vectors, queries, k):
    def cosine(a, b):
        a, b = (np.array(x or [], float) for x in (a, b))
        return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if len(a) == len(b) and a.any() and b.any() else 0.0

    out = {}
    for q in queries:
        found = sorted((-round(cosine(vectors[q], v), 9), i) for i, v in vectors.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


@pytest.mark.parametrize("gathered", [True, False])
def test_nearest_against_all_pairs(spark, gathered):
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(12, 8))
    vectors = {i: ((heads[i % 12] if gathered else 0) + (0.1 if gathered else 1) * rng.normal(size=8)).astype(np.float32).tolist() for i in range(400)}
    vectors |= {1000 + i: vectors[i] for i in range(0, 60, 2)}  # equal vectors: ties
    vectors |= {2000: None, 2001: [], 2002: [0.0] * 8, 2003: [1.0, 2.0], 2004: [2.0, 4.5], 2005: [3.0] * 5}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(4)
    asked = [0, 1, 7, 40, 1000, 1002, 2000, 2002, 2003, 2005]
    queries = df.filter(df.vec_id.isin(asked)).selectExpr("vec_id AS query_id", "embedding AS query")
    for k in (1, 5, 450):
        got = {}
        for r in nearest(df, queries, k).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], round(r["similarity"], 9) + 0.0))
        expected = brute(vectors, asked, k)
        assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in expected.items()}
        assert all(np.allclose([s for _, s in got[q]], [s for _, s in expected[q]], atol=1e-7) for q in asked)


def test_nearest_without_cross_joins(spark):
    for name in ("nearest_stories", "related_stories", "answer_passages"):
        plan = discovery.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), spark.createDataFrame([(1, [1.0])], "query_id long, query array<float>"), 3).count() == 0
