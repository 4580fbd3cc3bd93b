"""Phrases against plain counting."""

import random
import re
from collections import Counter

import pytest

from tests.support import differences
from tidemill.llm import phrases, queries

DOCS = "doc_id long, text string, lang string, n long, phrase string, a int, rank string"


def plain(rows, least, listed):
    f, n = {}, Counter()
    for r in rows:
        lang, text = r[2] or "und", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if a >= least}
        inside = {q[i : i + k] for q, b in good.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if c[q[i : i + k]] <= b}
        found = []
        for p, a in good.items():
            if len(p) > 1 and p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:listed])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["the", "of", "Ein", "ö", "𝔘x", "a b", "new", "york", "city", "x1"]
    texts = [" ".join(rng.choices(vocabulary, [9, 7, 3, 2, 1, 1, 3, 3, 2, 1], k=rng.randint(0, 40))) + rng.choice([".", "\n", " , ", "\t\t", "? "]) for _ in range(300)]
    more = ["", None, "  \t ", "." * 300, "New York city! " * 400, "same words here now then " * 200, "ONE"]
    return [(i if i % 7 else None, t, ["en", "de", None][i % 3 if i % 5 else 0], 5, "p", 1, "r") for i, t in enumerate(texts + more + more)]


@pytest.mark.parametrize("sizes", [{}, {"slice_words": 16, "bucket_words": 64}])
def test_phrases_against_counting(spark, rows, sizes):
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    for least, listed in ((3, 10_000), (20, 7)):
        got = sorted(tuple(r) for r in phrases.collocations(df, least=least, listed=listed, **sizes).collect())
        assert got == plain(rows, least, listed) and got


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, 1, "", 1, "")], DOCS)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_phrases_beyond_64_bits(spark):
    big = spark.createDataFrame([(4 * 10**12, 10**13, 5 * 10**12, 6 * 10**12)], "a long, n long, l long, r long")
    top = (phrases.F.lit(1000).cast("decimal(4,0)") * phrases._exact("a") * phrases._exact("n")).alias("t")
    got = big.select(top, (phrases._exact("l") * phrases._exact("r")).alias("b")).selectExpr("t div b AS s").first()["s"]
    assert got == 1000 * 4 * 10**12 * 10**13 // (5 * 10**12 * 6 * 10**12)


def test_phrases_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(queries.op11_phrase_collocations(spark, sf), phrases.SQL, sf) == ""
