"""Functions on literal cases and against plain loops."""

import hashlib
import math
import unicodedata
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions import dates, hashing, loose_json, search_query, text, urls, vectors
from tidemill.operators import clustering, ingest, scoring, search, stories
from tidemill.plans import discovery
from tidemill.sources import feeds
from tidemill.sources.readable import readable

from .support import differences, duck_rows

NOW = datetime(2026, 7, 26, 12)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def plain_normal(s):
    special = text.SPECIAL_LETTERS
    out = []
    for ch in unicodedata.normalize("NFD", s.lower()):
        if unicodedata.category(ch) == "Mn" and ord(ch) < 0x10000:
            continue
        out.append(special.get(ch, ch) if ord(ch) < 0x10000 and unicodedata.category(ch)[0] + unicodedata.category(ch)[1] in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd") else " ")
    return " ".join("".join(out).split())


@pytest.mark.parametrize(("raw", "expected"), [("GPT-6 Yayınlandı!", "gpt 6 yayinlandi"), ("  .NET   9   Released  ", "net 9 released"), ("Açık Kaynak Güncelleme", "acik kaynak guncelleme"), ("Straße", "strase"), (None, ""), ("  ", "")])
def test_normal_form(spark, raw, expected):
    assert one(spark, raw, text.normalize) == expected


def test_normal_form_of_many_scripts(spark):
    samples = ["Ångström Œuvre ﬁn", "한국어 텍스트", "日本語テキスト ガ", "Ελληνικά ΰ", "Йод ё", "a𝔘b𐐀c", "é ñ", "१२३ ٣", "İstanbul IĞDIR", "x_y.z"]
    rows = spark.createDataFrame([(s,) for s in samples], "x string").select("x", text.normalize(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == {s: plain_normal(s) for s in samples}


def test_shingles(spark):
    cut = lambda s: one(spark, s, lambda c: text.shingles(text.tokenize(text.normalize(c))))
    assert cut("dotnet nine release notes") == ["dotnet nine", "nine release", "release notes"]
    assert cut("The a of") == [] and cut("release the") == ["release"]


@pytest.mark.parametrize(("raw", "expected"), [
    ("https://example.com/post?utm_source=x&utm_medium=y", "https://example.com/post"), ("http://www.example.com/post/", "https://example.com/post"), ("https://Example.COM/Post#section", "https://example.com/Post"),
    ("https://example.com/post?id=5&utm_campaign=z", "https://example.com/post?id=5"), ("https://e.com/?b=2&a=&REF=q", "https://e.com/?a&b=2"), ("http://h:80", "https://h/"), ("https://h:8080/x", "https://h:8080/x"), (" no url ", "no url"), (None, ""),
])
def test_canonical_url(spark, raw, expected):
    assert one(spark, raw, urls.canonical_url) == expected


def test_html(spark):
    assert one(spark, "<p>a</p><p>b &amp;lt; &#x27;c&#39; &nope; &eacute;</p> d > e <unclosed", text.html_to_text) == "a b &lt; 'c' &nope; é d e"
    assert one(spark, "<br>", text.html_to_text) is None and one(spark, None, text.html_to_text) is None


def test_readable_body():
    long = "This paragraph is long enough to be taken as a part of the body text. " * 8
    page = f"<html><body><nav><p>{long}</p></nav><article><h2>A heading that has more than forty characters in it</h2><p>{long}<p>short</article><footer>{long}</footer></body></html>"
    assert readable(page) == "A heading that has more than forty characters in it\n\n" + long.strip()
    assert readable("<p>short</p>") is None and readable(None) is None and readable("<div>" * 5000) is None


def plain_fnv(b, bits):
    h, p = (hashing.BASIS_64, hashing.PRIME_64) if bits == 64 else (hashing.BASIS_32, hashing.PRIME_32)
    for x in b:
        h = (h ^ x) * p % (1 << bits)
    return h


def test_fnv():
    values = [b"", b"a", b"foobar", "ünïcode".encode(), b"x" * 300]
    for bits in (32, 64):
        assert hashing.fnv1a(values, bits).tolist() == [plain_fnv(v, bits) for v in values]


def test_simhash(spark):
    def near(a, b):
        df = spark.createDataFrame([(a,), (b,)], "t string").select(text.tokenize(text.normalize(F.col("t"))).alias("k")).select(hashing.simhash(F.array_join("k", " ")).alias("h"))
        x, y = (r["h"] for r in df.collect())
        return (np.int64(x).view(np.uint64) ^ np.int64(y).view(np.uint64)).item().bit_count()

    a = "OpenAI releases a new model for developers that writes better code and runs faster on cheap hardware"
    assert near(a, a) == 0 and near(a, "Football club wins the national cup after dramatic penalty shootout in the final game") > 20
    assert hashing._simhash_batch(["", "x", None], 2).tolist() == [0, np.uint64(plain_fnv(b"x", 64)).view(np.int64), 0]
    assert hashing._simhash_batch(["", "a b c b c", ""], 2).view(np.uint64)[1] == sum(1 << i for i in range(64) if 2 * sum(plain_fnv(x, 64) >> i & 1 for x in (b"a b", b"b c", b"c b", b"b c")) > 4)
    assert hashing._simhash_batch(["a b a b"], 2).view(np.uint64)[0] == sum(1 << i for i in range(64) if 2 * sum(plain_fnv(x, 64) >> i & 1 for x in (b"a b", b"b a", b"a b")) > 3)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 1.0]), (2, None, [1.0]), (3, [0.0], [1.0]), (4, [1.0], [1.0, 2.0])], "k int, a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.orderBy("k").select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0, 0, 0]
    c = {r["k"]: r["centroid"] for r in vectors.centroid(df.selectExpr("k % 2 AS k", "b"), ["k"], "b").collect()}
    assert c == {0: None, 1: None} and vectors.centroid(df.filter("k = 1"), ["k"], "b").first()["centroid"] == [1.0, 1.0]
    assert one(spark, [3.0, 4.0], vectors.unit, "array<float>") == pytest.approx([0.6, 0.8], rel=1e-6) and one(spark, [0.0], vectors.unit, "array<float>") == [0.0]


@pytest.mark.parametrize(("raw", "expected"), [
    ("Son bir ayda çıkan AI haberleri", ("ai", 30, False)), ("son 3 ayda MCP hakkında neler oldu", ("mcp hakkinda neler oldu", 90, False)), ("resmi kaynak news", ("resmi kaynak news", None, True)), ("small models", ("sm models", None, False)),
])
def test_search_query(spark, raw, expected):
    assert tuple(one(spark, raw, lambda c: search_query.parse(text.normalize(c)))) == expected


def test_loose_json(spark):
    got = one(spark, 'x ```json {"a": "1.5", "b": [1, 2,], // c\n "c": null,} ``` y', lambda c: F.struct(loose_json.number(loose_json.extract(c), "a"), loose_json.strings(loose_json.extract(c), "b"), loose_json.string(loose_json.extract(c), "c", "d")))
    assert tuple(got) == (1.5, ["1", "2"], "d") and one(spark, "no braces", loose_json.extract) is None


def test_unknown_zone_is_utc(spark):
    assert one(spark, "Nowhere/Land", lambda z: dates.local(F.lit(NOW), z, ["Europe/Istanbul"])) == NOW


def story(spark, **over):
    base = {"distinct_source_count": 1, "official_source_count": 0, "max_trust_weight": 0.6, "published_at": NOW - timedelta(hours=2), "engagement": 0, "technical_accuracy": None, "category": "Software"} | over
    kinds = "distinct_source_count int, official_source_count int, max_trust_weight double, published_at timestamp, engagement int, technical_accuracy double, category string"
    return scoring.importance(scoring.trust(spark.createDataFrame([tuple(base.values())], kinds), F.lit(NOW)), F.lit(NOW)).first()


def test_trust(spark):
    assert story(spark)["corroboration"] == 32 and story(spark, distinct_source_count=3)["corroboration"] == 63
    assert [story(spark, distinct_source_count=n)["corroboration"] for n in (8, 50)] == [100, 100]
    assert story(spark, published_at=NOW + timedelta(hours=5))["recency"] == 100 and story(spark, published_at=NOW - timedelta(days=365))["recency"] == 20
    assert story(spark, official_source_count=1)["official"] == 70 and story(spark, official_source_count=9)["official"] == 100
    assert story(spark, official_source_count=2, distinct_source_count=4)["trust_reason"].endswith("— 2 resmi kaynak, 4 kaynak doğruladı, son 24 saat.")
    assert story(spark, category="Ai")["importance_score"] > story(spark, category="Career")["importance_score"]


def test_edition(spark):
    rows = [(0, i, "Ai", 100.0 - i) for i in range(20)] + [(0, 100 + i, "Other", 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "user_id int, story_id int, category string, score double")
    picked = scoring.compose(df, 6, 4).orderBy("rank").collect()
    assert [r["category"] for r in picked] == ["Ai"] * 4 + ["Other"] * 2
    assert scoring.compose(df.filter("category = 'Ai'"), 8, 3).count() == 8


def articles(spark, rows):
    return spark.createDataFrame([(i, h, s, e, NOW - timedelta(hours=t)) for i, h, s, e, t in rows], "article_id long, content_hash string, simhash long, embedding array<float>, published_at timestamp")


def test_clusters(spark):
    df = articles(spark, [(1, "a", 0b1111, None, 200), (2, "b", 0b1110, None, 190), (3, "a", 0b1111, None, 100), (4, "c", 0, None, 50), (5, "d", 0, None, 50), (6, "e", -1, None, 49), (7, "c", 0, None, 40), (8, "b", 0b1110, None, 10)])
    got = {r["article_id"]: (r["story_id"], r["match"]) for r in clustering.cluster(df).collect()}
    assert got == {1: (1, "New"), 2: (1, "NearDuplicate"), 3: (3, "New"), 4: (4, "New"), 5: (5, "New"), 6: (6, "New"), 7: (4, "ExactHash"), 8: (8, "New")}


def test_clusters_are_as_one_pass(spark):
    rng = np.random.default_rng(4)
    seeds = rng.integers(1, 2**62, 8)
    rows = []
    for i in range(150):
        h = int(seeds[rng.integers(8)])
        for b in rng.integers(0, 60, 4).tolist():
            h ^= 1 << b
        rows.append((i, f"h{h % 40}-{h}", h, None, float(rng.integers(0, 900))))
    df = articles(spark, rows)
    whole = clustering._assign(df.toPandas())
    got = {r["article_id"]: r["story_id"] for r in clustering.cluster(df).collect()}
    assert got == dict(zip(whole["article_id"], whole["story_id"], strict=True))


def test_clusters_by_vectors_are_as_one_pass(spark):
    """Several blocks of vectors, null and zero ones, equal texts, two widths."""
    rng = np.random.default_rng(8)
    seeds = rng.standard_normal((9, 16))
    contents = []
    for i in range(200):
        k = int(rng.integers(9))
        v = None if i % 17 == 0 else [0.0] * 16 if i % 23 == 0 else (seeds[k] + 0.3 * rng.standard_normal(16))[: 16 if i % 5 else 8].tolist()
        contents.append((f"h{i}", 0 if i % 2 else int(rng.integers(1, 2**62)), v))
    rows = [(i, *contents[int(rng.integers(200))], float(rng.integers(0, 500))) for i in range(260)]
    df = articles(spark, rows)
    whole = clustering._assign(df.toPandas())
    before, clustering.BLOCK = clustering.BLOCK, 40
    got = {r["article_id"]: (r["story_id"], r["match"]) for r in clustering.cluster(df).collect()}
    clustering.BLOCK = before
    assert got == {a: (s, m) for a, s, m in zip(whole["article_id"], whole["story_id"], whole["match"], strict=True)} and (whole["match"] == "Semantic").sum() > 50


def test_block_masks_lose_no_pair():
    rng = np.random.default_rng(0)
    for n in (10, 10**5, 10**7):
        masks = [m % (1 << 64) for m in clustering.block_masks(n)]
        for _ in range(100):
            apart = sum(1 << int(b) for b in rng.choice(64, hashing.NEAR_BITS, replace=False))
            assert any(not apart & m for m in masks)


def test_semantic_match(spark):
    df = articles(spark, [(1, "a", 1 << 40, [1.0, 0.9, 0.8, 0.2], 10), (2, "b", (1 << 62) - 1, [0.98, 0.92, 0.79, 0.22], 5)])
    assert {r["article_id"]: r["match"] for r in clustering.cluster(df).collect()} == {1: "New", 2: "Semantic"}


def test_schedule(spark):
    kinds = "is_enabled boolean, last_fetched_at timestamp, consecutive_failures int, fetch_interval_minutes int"
    rows = [(True, NOW - timedelta(minutes=31), 2, 30), (True, NOW - timedelta(hours=3, minutes=31), 2, 30), (False, None, 0, 30), (True, None, 0, 30)]
    assert ingest.due(spark.createDataFrame(rows, kinds), F.lit(NOW)).count() == 2


def test_sources(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>1</id><title>A &amp;amp; B</title><link rel="alternate" href="http://e/1"/><updated>2026-07-01T10:00:00Z</updated><content type="html">&lt;p&gt;Body&lt;/p&gt;</content><author><name>N</name></author></entry><entry><title>no link</title></entry></feed>'
    rss = '<rss><channel><item><title>T</title><link>http://e/2</link><description>D</description><pubDate>Wed, 01 Jul 2026 10:00:00 GMT</pubDate><enclosure url="http://e/i.png" type="image/png"/></item></channel></rss>'
    reddit = '{"data":{"children":[{"data":{"id":"p","title":"R","score":50,"is_self":true,"permalink":"/r/x","created_utc":1.0,"thumbnail":"self"}},{"data":{"id":"q","title":"low","score":3}},{"data":{"title":"s","score":99,"stickied":true}}]}}'
    github = '{"items":[{"id":5,"full_name":"a/b","language":"C","stargazers_count":7,"topics":["t"],"created_at":"2026-07-01T00:00:00Z"},{"id":6}]}'
    rows = [("1", "Atom", 0, atom), ("2", "Rss", 0, rss), ("3", "Reddit", 0, reddit), ("4", "GitHubTrending", 0, github), ("5", "HackerNews", 0, '{"id":9,"type":"story","score":25,"title":"H","time":1}'), ("6", "JsonFeed", 0, ""), ("7", "Rss", 0, "<!DOCTYPE x><rss/>"), ("8", "Rss", 0, "broken")]
    got = feeds.read_feeds(spark.createDataFrame(rows, "source_id string, kind string, position int, body string"))
    r = {x["source_id"]: x for x in got["Rss"].collect()}
    assert set(r) == {"1", "2"} and r["1"]["title"] == "A & B" and r["1"]["content"] == "Body" and r["1"]["author"] == "N" and r["2"]["external_id"] == "http://e/2" and r["2"]["image_url"] == "http://e/i.png"
    assert r["1"]["published_at"] == r["2"]["published_at"] == datetime(2026, 7, 1, 10)
    assert [(x["external_id"], x["url"], x["image_url"]) for x in got["Reddit"].collect()] == [("p", "https://www.reddit.com/r/x", None)]
    assert [(x["title"], x["content"]) for x in got["GitHubTrending"].collect()] == [("a/b: yeni depo", "Dil: C. 7 yıldız, 0 fork. Konular: t.")]
    assert got["HackerNews"].first()["url"].endswith("id=9") and got["unknown"].first()["kind"] == "JsonFeed"


def test_photos(spark):
    shared = '<script>window._sharedData = {"a":[{"display_url":"u1","shortcode":"c1","id":"7"},{"display_url":"u1","shortcode":"c1","id":"7"}]};</script>'
    mirror = '<img class="x post-image" src="http://m/1"><img class="post-image" data-src="http://m/2"><img class="post-image" src="http://m/s150x150">'
    rows = [(1, shared), (2, '<meta property="og:image" content="http://o/1">'), (3, mirror), (4, None)]
    got = {(r["page"], r["position"]): (r["id"], r["image_url"]) for r in feeds.photos(spark.createDataFrame(rows, "p int, html string"), "p", "html").collect()}
    assert got == {(1, 0): ("7", "u1"), (2, 0): ("meta_0", "http://o/1"), (3, 0): ("picuki_0", "http://m/1"), (3, 1): ("picuki_1", "http://m/2")}
    lazy = one(spark, mirror + '<div class="photo-description"><b>hi</b></div>', lambda c: feeds.mirror_images(c, "p", True))
    assert [(x["image_url"], x["caption"]) for x in lazy] == [("http://m/1", "hi"), ("http://m/2", None)]
    assert one(spark, " @me ", feeds.user_name) == "me"


def test_labels(spark):
    ago = lambda **d: one(spark, NOW - timedelta(**d), lambda c: text.time_ago(c, F.lit(NOW)), "timestamp")
    assert [ago(seconds=10), ago(minutes=5), ago(hours=3), ago(days=2), ago(days=9)] == ["az önce", "5 dk önce", "3 sa önce", "2 gün önce", "17.7."]
    assert one(spark, 3.5, text.percent_label, "double") == "+4%" and one(spark, 71, text.trust_band, "int") == "Güvenilir"


def test_fallbacks(spark):
    near, overlap = spark.createDataFrame([(1, 5)], "query_id int, id int"), spark.createDataFrame([(1, 6), (2, 7)], "query_id int, id int")
    assert sorted(map(tuple, search.related(near, overlap).collect())) == [(1, 5), (2, 7)]
    c = spark.createDataFrame([([9, 2], [1, 2, 3, 4]), ([9], [1, 2, 3, 4])], "n array<int>, c array<int>").select(search.citations(F.col("n"), F.col("c")).alias("x")).collect()
    assert [r["x"] for r in c] == [[2], [1, 2, 3]]
    s = spark.createDataFrame([(1, "Published", NOW - timedelta(days=9), 5, 5), (2, "Draft", NOW, 9, 9)], "story_id int, status string, published_at timestamp, importance_score int, trust_score int")
    assert stories.top_story(s, F.lit(NOW - timedelta(hours=36))).first()["story_id"] == 1


def test_hash_of_normal_form(spark):
    assert one(spark, "A b!", lambda c: text.content_hash(text.normalize(c))) == hashlib.sha256(b"a b").hexdigest().upper()


def test_topic_terms_are_what_is_hashed(spark, monkeypatch, capsys):
    texts = spark.range(100).selectExpr("id", "concat('red ring ', id) AS title_n", "concat('red ring ', id, ' blue') AS body_n")
    terms = spark.createDataFrame([("a", "red ring"), ("b", "blue")], "slug string, term string")
    for most, kind in ((search.BROADCAST, "BroadcastHashJoin"), (1, "ShuffledHashJoin")):
        monkeypatch.setattr(search, "BROADCAST", most)
        tags = search.topic_matches(texts, terms)
        tags.explain()
        joined = [line for line in capsys.readouterr().out.splitlines() if "Join" in line]
        assert len(joined) == 1 and kind in joined[0] and "BuildRight" in joined[0]  # never the texts' sequences
        assert sorted(map(tuple, tags.filter("id < 1").collect())) == [(0, "a", 1.0), (0, "b", 0.6)] and tags.count() == 200


def test_topic_centroids_round_the_mean_itself(spark, tmp_path):
    a, b = 1.0000048875808716, 1.0000050067901611  # neighbouring floats; their mean is below 1.000005 and no float
    rows = [(1, [a, -1e-7], 0), (2, [b, -1e-7], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    made, sql = discovery.topic_centroids(spark, str(tmp_path)), discovery.SQL["topic_centroids"]
    assert [list(r["centroid"]) for r in made.collect()] == [[1.0, 0.0]] and not differences(made, sql, str(tmp_path))
    zero = [v for _, rows in [duck_rows(sql, str(tmp_path))] for v in list(rows)[0][0]][1]
    assert zero == 0 and math.copysign(1, zero) == 1  # as Spark rounds: not -0.0


def test_topic_overlap_lists_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    topics = {i: sorted(rng.choice(9, rng.integers(1, 6), replace=False).tolist()) for i in range(300)}
    weight = {i: int(rng.integers(0, 6)) for i in topics}
    plain = {}
    for q in range(0, 300, 7):
        found = sorted((-len({*topics[q]} & {*t}), -weight[i], i) for i, t in topics.items() if i != q and {*topics[q]} & {*t})
        plain[q] = [(q, r + 1, i, -n) for r, (n, _, i) in enumerate(found[:5])]
    pairs = spark.createDataFrame([(i, t) for i, own in topics.items() for t in own], "story_id long, topic_id long")
    asked = spark.createDataFrame([(q,) for q in plain], "query_id long")
    scores = spark.createDataFrame([*weight.items()], "story_id long, importance_score int")
    for most in (10, 2):  # all stories by their subsets; those of three topics and more by topic
        monkeypatch.setattr(search, "SUBSETS", most)
        assert sorted(map(tuple, search.topic_overlap(pairs, asked, scores).collect())) == sorted(r for rows in plain.values() for r in rows)
    monkeypatch.setattr(search, "SUBSETS", 10)
    monkeypatch.setattr(search, "_by_topic", lambda *_: pytest.fail("stories of a few topics were met topic by topic"))
    search.topic_overlap(pairs, asked, scores).collect()


def test_python_holds_pieces_of_a_batch(monkeypatch):
    """However large Spark's batches are, no more than a piece is made at a time."""
    import pyarrow as pa

    from tidemill.sources import readable

    pages = pa.array(["<article><p>" + f"{i} word " * 30 + "</p></article>" for i in range(300)] + [None])
    parts = list(readable.readable_body.func(iter([pages, pages.slice(0, 0)])))
    assert max(map(len, parts)) == readable.PIECE and [x.as_py() for p in parts for x in p] == [readable.readable(h) for h in pages.to_pylist()]
    monkeypatch.setattr(hashing.F, "arrow_udf", lambda kind: lambda f: f)
    texts = pa.array([f"word{i} word{i % 7} other" for i in range(700)] + [None, ""])
    parts = list(hashing.hashed_embedding(iter([texts, texts.slice(0, 0)]), 8))
    assert max(map(len, parts)) == hashing.PIECE and sum(map(len, parts)) == len(texts)
    alone = [next(hashing.hashed_embedding(iter([texts.slice(i, 1)]), 8))[0].as_py() for i in (0, 300, 699, 700, 701)]
    assert [pa.chunked_array(parts)[i].as_py() for i in (0, 300, 699, 700, 701)] == alone


def test_embeddings_are_of_whole_texts(spark):
    """The last words of a text of 40,000 characters count as its first ones do."""
    from tidemill.plans import discovery

    rows = [(1, "title", "word " * 8000 + "first end"), (2, "title", "word " * 8000 + "second end"), (3, "title", "word " * 8000 + "first end")]
    own = [r["e"] for r in spark.createDataFrame(rows, "id long, title string, content string").select("id", discovery.embedding().alias("e")).orderBy("id").collect()]
    assert own[0] == own[2] != own[1] and any(own[0])


def test_readable_body_of_a_long_page():
    """A body of over 50,000 characters is taken to its end."""
    body = readable("<article>" + "".join(f"<p>Paragraph {i} of a page that goes on and on, with words enough.</p>" for i in range(2000)) + "</article>")
    assert len(body) > 120_000 and body.endswith("Paragraph 1999 of a page that goes on and on, with words enough.")


def test_topic_overlap_gathers_no_lists_of_subsets(spark):
    """Lists of subsets look as small to Spark as the topics they are made of; one that is broadcast goes through the driver."""
    rng = np.random.default_rng(6)
    rows = [(i, sorted(rng.choice(12, rng.integers(1, 8), replace=False).tolist()), int(rng.integers(0, 9))) for i in range(300)]
    best = spark.createDataFrame([(i, w, t) for i, t, w in rows], "id long, importance_score int, topics array<long>")
    own = spark.createDataFrame([(i, t) for i, t, _ in rows if i % 5 == 0], "query_id long, topics array<long>")
    found = search._by_subset(best, own, 5)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in sorted(found.collect(), key=lambda r: (-r["shared"], -r["importance_score"], r["id"])):
        got.setdefault(r["query_id"], []).append((r["id"], r["shared"]))
    for q, topics, _ in rows[::5]:
        others = sorted((-len(set(t) & set(topics)), -w, i) for i, t, w in rows if i != q and set(t) & set(topics))
        assert got[q][:5] == [(i, -n) for n, _, i in others[:5]]
