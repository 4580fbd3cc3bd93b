"""Quality rules against plain counting, and the trees."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import quality, queries

SF = "/root/testdata/sf0.001"
WORD = "[^\x20\x09-\x0d]+"
DOCS = "doc_id long, text string, quality int, score string, n_words int, kept string, id string"


def base(text):
    w = re.findall(WORD, text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len({i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    some = ["a", "b", "#x", "ü𝔘", "é|", "c\nd", "\n", "\t", "\r\n", "\x0b", "\x85", "&nbsp;", " y"]
    return [None, "", " \n\t ", "x" * 100_000, "one two three four five " * 2000, "same line here\n" * 50, *("".join(rng.choice(some) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300))]


def test_base_against_counting(texts):
    got, features = quality.statistics(pa.array(texts, pa.string()))
    assert list(map(tuple, got.T.tolist())) == [base(t) for t in texts]
    assert np.isfinite(features).all() and (features[:, :3] == 0).all()
    part = pa.array(texts, pa.string()).slice(3, 100)  # not from the start of a buffer
    assert list(map(tuple, quality.statistics(part)[0].T.tolist())) == [base(t) for t in texts[3:103]]


def test_query_against_counting(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in queries.op12_quality_rules(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        expected = base(t)
        assert tuple(got[i][c] for c in ("n_words", *quality.BASE)) == expected
        assert got[i]["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_labels_left_out_are_told(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels.filter("doc_id % 2 = 0")).filter("NOT base_failed").collect()}
    good, bad = ([kept[i] for i, q in known.items() if i % 2 and i in kept and q == k] for k in (1, 0))
    assert len(bad) > 5 and sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def walked(model, row):
    total = model.bias
    for k in model.root:
        while model.left[k] != k:
            k = model.left[k] if row[model.feature[k]] <= model.split[k] else model.right[k]
        total += model.value[k]
    return total


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = (np.sin(2 * x[:, 0]) - 0.8 * x[:, 1] + 0.5 * np.cos(3 * x[:, 1]) + x[:, 2] * x[:, 3] + rng.normal(size=3000) * 0.3 > 0).astype(float)
    model = quality.train(x, y, (1,))
    score = model.score(x)
    assert ((score > 0.5) == (y > 0.5)).mean() > 0.85
    assert np.allclose(model.margin(x[:50]), [walked(model, r) for r in x[:50]])
    grid = np.linspace(-4, 4, 200)
    for row in x[:100]:  # falls with the second statistic, whatever the others are
        assert (np.diff(model.margin(np.column_stack([np.full(200, row[0]), grid, np.full(200, row[2]), np.full(200, row[3])]))) <= 1e-9).all()
    free = quality.train(x, y)
    assert any((np.diff(free.margin(np.column_stack([np.full(200, r[0]), grid, np.full(200, r[2]), np.full(200, r[3])]))) > 1e-6).any() for r in x[:100])


def test_one_kind_of_label_and_odd_rows(spark, texts):
    rows = [(i if i % 9 else None, t, 1, "s", 2, "k", "i") for i, t in enumerate(texts[:40] + texts[:10])]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (4, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, labels)
    assert out.columns == ["doc_id", "n_words", *quality.BASE, "base_failed", "score", "kept"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["kept"] != r["base_failed"] for r in got)
    assert quality.judge(docs.limit(0), labels).count() == 0 and quality.judge(docs, labels.limit(0)).count() == len(rows)
