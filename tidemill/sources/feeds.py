"""Feeds as rows: RSS and Atom, three JSON services, photo pages. Inputs are columns of fetched texts, so that a connector,
a table or a stream can supply them; parsing stays in the JVM but for XML with its namespaces and nested JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions.text import html_to_text

# What marks embedded data and preview images on photo pages, and photos and captions on mirrors.
SHARED_DATA = r"(?s)window\._sharedData\s*=\s*(\{.*?\});</script>"
LOADED_DATA = r"(?s)window\.__additionalDataLoaded\s*\([^,]+,\s*(\{.*?\})\);"
PREVIEW_IMAGE = r'<meta[^>]+property="og:image"[^>]+content="([^"]+)"'
MIRROR_IMAGE = r'<img[^>]+class="[^"]*post-image[^"]*"[^>]+src="([^"]+)"'
MIRROR_TAG = r'(?i)<img[^>]+class="[^"]*post-image[^"]*"[^>]*>'
MIRROR_CAPTION = r'(?is)<div[^>]+class="[^"]*photo-description[^"]*"[^>]*>(.*?)</div>'
THUMBNAIL = "s150x150"

MOST_ITEMS = 50
ITEM = "external_id string, url string, title string, author string, excerpt string, content string, image_url string, published_at timestamp, engagement_score int, comment_count int"
#: Which parser reads which kind of source; a kind that isn't here is an error.
RSS_KINDS = ("Rss", "Atom", "YouTubeRss", "ArXiv", "ProductHunt", "PapersWithCode", "GitHubReleases")


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def _cut(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def _numbered(df: DataFrame, keys: list[str], keep: Column | None = None) -> DataFrame:
    """The first MOST_ITEMS of each feed by position, of those that pass ``keep``."""
    own = df if keep is None else df.filter(keep)
    return own.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("position"))).filter(F.col("_k") <= MOST_ITEMS).drop("_k")


def _rss_items(body: str | None) -> list[dict]:
    """Raw fields of the first MOST_ITEMS items of an RSS or Atom text; none if it can't be read or declares a DTD."""
    if not body or "<!DOCTYPE" in body[:2000]:
        return []
    try:
        root = ElementTree.fromstring(body.strip())
    except ElementTree.ParseError:
        return []
    local = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    out = []
    for entry in [e for e in root.iter() if local(e) in ("item", "entry")][:MOST_ITEMS]:
        found: dict = {"links": []}
        for e in entry:
            name, value = local(e), "".join(e.itertext()).strip()
            if name == "link":
                found["links"].append((e.get("rel"), e.get("href") or value, e.get("type") or ""))
            elif name == "enclosure":
                found["links"].append(("enclosure", e.get("url") or "", e.get("type") or ""))
            elif name in ("thumbnail", "content") and e.get("url"):
                found.setdefault("media", e.get("url"))
            elif name == "group":
                for m in e:
                    if local(m) in ("thumbnail", "content") and m.get("url"):
                        found.setdefault("media", m.get("url"))
            elif name in ("author", "creator"):
                names = [x.text for x in e if local(x) == "name" and x.text]
                found.setdefault("author", names[0] if names else value or None)
            else:
                key = {"guid": "id", "description": "summary", "encoded": "content", "pubDate": "published", "date": "published"}.get(name, name)
                found.setdefault(key, value)
        link = next((h for rel, h, _ in found["links"] if rel in (None, "alternate") and h), None) or next((h for _, h, _ in found["links"] if h), None)
        image = next((h for rel, h, kind in found["links"] if rel == "enclosure" and kind.lower().startswith("image/") and h), None)
        out.append({"link": link, "image": image or found.get("media"), "when": _moment(found.get("published")) or _moment(found.get("updated")), **{k: found.get(k) for k in ("id", "title", "author", "summary", "content")}})
    return out


def _moment(text: str | None) -> datetime | None:
    for read in (lambda t: datetime.fromisoformat(t), parsedate_to_datetime):
        try:
            found = read(text)
            return (found if found.tzinfo else found.replace(tzinfo=UTC)).astimezone(UTC).replace(tzinfo=None)
        except (TypeError, ValueError):
            continue
    return None


def rss(feeds: DataFrame) -> DataFrame:
    """Items of (source_id, kind, body): the first MOST_ITEMS of each, then those with link and title."""
    raw = "source_id string, kind string, position int, id string, link string, title string, author string, summary string, content string, image string, when timestamp_ntz"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in raw.split(", ")]
        for f in frames:
            rows = [{"source_id": s, "kind": k, "position": i, **item} for s, k, body in zip(f["source_id"], f["kind"], f["body"], strict=True) for i, item in enumerate(_rss_items(body))]
            yield pd.DataFrame(rows, columns=names)

    items = feeds.select(F.col("source_id").cast("string"), "kind", "body").mapInPandas(work, raw)
    excerpt, body = html_to_text(F.coalesce("summary", "content")), html_to_text(F.coalesce("content", "summary"))
    kept = items.filter(_filled(F.col("link")).isNotNull() & _filled(F.col("title")).isNotNull())
    return kept.select(
        "source_id", "position", F.coalesce(_filled(F.col("id")), F.col("link")).alias("external_id"), F.col("link").alias("url"), F.coalesce(html_to_text(F.col("title")), F.col("title")).alias("title"), "author",
        _cut(excerpt, 4000).alias("excerpt"), F.when(F.col("kind") == "YouTubeRss", excerpt).otherwise(_cut(body, 50_000)).alias("content"), F.col("image").alias("image_url"), F.col("when").cast("timestamp").alias("published_at"),
        F.lit(0).alias("engagement_score"), F.lit(0).alias("comment_count"),
    )


def hacker_news(items: DataFrame, least: int = 25) -> DataFrame:
    """(source_id, position, body): one JSON item a row; of the first MOST_ITEMS, the stories with ``least`` points and a title."""
    kind = "struct<id:long,type:string,score:int,title:string,url:string,by:string,text:string,time:long,descendants:int>"
    j = _numbered(items, ["source_id"]).withColumn("j", F.from_json("body", kind)).filter((F.col("j.type") == "story") & (F.col("j.score") >= least) & _filled(F.col("j.title")).isNotNull())
    ident = F.col("j.id").cast("string")
    return j.select(
        "source_id", "position", ident.alias("external_id"), F.coalesce(_filled(F.col("j.url")), F.concat(F.lit("https://news.ycombinator.com/item?id="), ident)).alias("url"), F.col("j.title").alias("title"), F.col("j.by").alias("author"),
        html_to_text(F.col("j.text")).alias("excerpt"), F.timestamp_seconds("j.time").alias("published_at"), F.col("j.score").alias("engagement_score"), F.coalesce("j.descendants", F.lit(0)).alias("comment_count"),
    )


def reddit(listings: DataFrame, least: int = 40) -> DataFrame:
    """(source_id, body): a JSON listing a row; posts that aren't pinned, with ``least`` points and a title, the first MOST_ITEMS of these."""
    post = "struct<id:string,permalink:string,title:string,url:string,author:string,selftext:string,thumbnail:string,created_utc:double,score:int,num_comments:int,stickied:boolean,is_self:boolean>"
    each = listings.select("source_id", F.posexplode(F.from_json("body", f"struct<data:struct<children:array<struct<data:{post}>>>>")["data"]["children"]).alias("position", "c")).select("source_id", "position", "c.data.*")
    good = ~F.coalesce("stickied", F.lit(False)) & (F.col("score") >= least) & _filled(F.col("title")).isNotNull()
    thread = F.concat(F.lit("https://www.reddit.com"), F.coalesce("permalink", F.lit("")))
    return _numbered(each, ["source_id"], good).select(
        "source_id", "position", F.coalesce("id", "permalink", "title").alias("external_id"), F.when(F.coalesce("is_self", F.lit(False)), thread).otherwise(F.coalesce(_filled(F.col("url")), thread)).alias("url"), "title", "author",
        html_to_text(F.col("selftext")).alias("excerpt"), F.when(F.lower("thumbnail").startswith("http"), F.col("thumbnail")).alias("image_url"), F.timestamp_seconds(F.col("created_utc").cast("long")).alias("published_at"),
        F.col("score").alias("engagement_score"), F.coalesce("num_comments", F.lit(0)).alias("comment_count"),
    )


def github(results: DataFrame) -> DataFrame:
    """(source_id, body): a JSON search result a row; repositories with a name, the first MOST_ITEMS."""
    repo = "struct<id:long,full_name:string,description:string,html_url:string,language:string,stargazers_count:int,forks_count:int,created_at:string,topics:array<string>,owner:struct<login:string>>"
    each = results.select("source_id", F.posexplode(F.from_json("body", f"struct<items:array<{repo}>>")["items"]).alias("position", "r")).select("source_id", "position", "r.*")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    described = F.concat_ws(
        " ", _filled(F.col("description")), F.concat(F.lit("Dil: "), _filled(F.col("language")), F.lit(".")), F.concat(count("stargazers_count"), F.lit(" yıldız, "), count("forks_count"), F.lit(" fork.")),
        F.when(F.size("topics") > 0, F.concat(F.lit("Konular: "), F.array_join(F.slice("topics", 1, 10), ", "), F.lit("."))),
    )
    return _numbered(each, ["source_id"], _filled(F.col("full_name")).isNotNull()).select(
        "source_id", "position", F.col("id").cast("string").alias("external_id"), F.coalesce("html_url", F.concat(F.lit("https://github.com/"), "full_name")).alias("url"),
        F.concat("full_name", F.lit(": "), F.coalesce("description", F.lit("yeni depo"))).alias("title"), F.col("owner.login").alias("author"), F.col("description").alias("excerpt"), described.alias("content"),
        F.to_timestamp("created_at").alias("published_at"), F.col("stargazers_count").alias("engagement_score"),
    )


def read_feeds(fetched: DataFrame) -> dict[str, DataFrame]:
    """Items by parser of (source_id, kind, position, body); ``unknown`` holds the sources that no parser handles."""
    of = lambda *kinds: fetched.filter(F.col("kind").isin(*kinds))
    known = ("HackerNews", "Reddit", "GitHubTrending", *RSS_KINDS)
    return {
        "HackerNews": hacker_news(of("HackerNews")), "Reddit": reddit(of("Reddit")), "GitHubTrending": github(of("GitHubTrending")), "Rss": rss(of(*RSS_KINDS)),
        "unknown": fetched.filter(~F.col("kind").isin(*known)).select("source_id", "kind"),
    }


_PHOTOS = ArrayType(StructType().add("id", StringType()).add("image_url", StringType()).add("thumbnail_url", StringType()).add("caption", StringType()).add("post_url", StringType()))


def _photo_nodes(text: str | None) -> list[dict]:
    """Photos in nested JSON, to a depth of ten; the first of each id."""
    try:
        root = json.loads(text) if text else None
    except ValueError:
        return []
    found: dict[str, dict] = {}
    stack = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if depth >= 10:
            continue
        below = []
        if isinstance(node, dict):
            image, code = node.get("display_url"), node.get("shortcode")
            if isinstance(image, str) and isinstance(code, str):
                key = node["id"] if isinstance(node.get("id"), str) else code
                captions = ((node.get("edge_media_to_caption") or {}).get("edges") or [{}]) if isinstance(node.get("edge_media_to_caption") or {}, dict) else [{}]
                caption = ((captions[0] or {}).get("node") or {}).get("text") if isinstance(captions[0], dict) else None
                thumb = node.get("thumbnail_src") if isinstance(node.get("thumbnail_src"), str) else image
                found.setdefault(key, {"id": key, "image_url": image, "thumbnail_url": thumb, "caption": caption, "post_url": f"https://www.instagram.com/p/{code}/"})
            below = list(node.values())
        elif isinstance(node, list):
            below = node
        stack += [(x, depth + 1) for x in reversed(below)]
    return list(found.values())


@F.pandas_udf(_PHOTOS)
def photo_nodes(texts: pd.Series) -> pd.Series:
    return texts.map(_photo_nodes)


def photos(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, position, image_url, …) of photo pages: embedded JSON, else preview images, else a mirror's images; the first
    of these ways that finds any."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    shared = F.regexp_extract(html, SHARED_DATA, 1)
    loaded = F.regexp_extract(html, LOADED_DATA, 1)
    plain = lambda urls, prefix: F.transform(urls, lambda u, i: F.struct(F.concat(F.lit(prefix), i.cast("string")).alias("id"), u.alias("image_url"), u.alias("thumbnail_url"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("post_url")))
    preview = plain(F.regexp_extract_all(html, F.lit(PREVIEW_IMAGE)), "meta_")
    own = pages.select(F.col(id_col).alias("page"), photo_nodes(shared).alias("a"), photo_nodes(loaded).alias("b"), preview.alias("c"), mirror_images(html, "picuki_", False).alias("d"))
    first = F.when(F.size("a") > 0, F.col("a")).when(F.size("b") > 0, F.col("b")).when(F.size("c") > 0, F.col("c")).otherwise(F.col("d"))
    return own.select("page", F.posexplode(first).alias("position", "p")).select("page", "position", "p.*")


def mirror_images(html: Column, prefix: str, lazily: bool) -> Column:
    """Photos of a mirror page, thumbnails left out. ``lazily``: ``data-src`` counts too, URLs must begin with http, each
    counts once, and captions come from the descriptions in order."""
    if not lazily:
        urls = F.regexp_extract_all(html, F.lit(MIRROR_IMAGE))
        kept = F.filter(F.transform(urls, lambda u, i: F.struct(i.alias("i"), u.alias("u"))), lambda x: x["u"].contains("http") & ~x["u"].contains(THUMBNAIL))
        return F.transform(kept, lambda x: F.struct(F.concat(F.lit(prefix), x["i"].cast("string")).alias("id"), x["u"].alias("image_url"), x["u"].alias("thumbnail_url"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("post_url")))
    tags = F.regexp_extract_all(html, F.lit(MIRROR_TAG), F.lit(0))
    url = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r'\ssrc="([^"]+)"', 1), F.lit("")), F.regexp_extract(t, r'\sdata-src="([^"]+)"', 1))
    urls = F.array_distinct(F.filter(F.transform(tags, url), lambda u: u.startswith("http") & ~u.contains(THUMBNAIL)))
    said = F.regexp_extract_all(html, F.lit(MIRROR_CAPTION))
    captions = F.transform(said, lambda c: F.nullif(F.trim(F.regexp_replace(c, r"<[^>]+>", "")), F.lit("")))
    return F.transform(urls, lambda u, i: F.struct(F.concat(F.lit(prefix), i.cast("string")).alias("id"), u.alias("image_url"), u.alias("thumbnail_url"), F.try_element_at(captions, i + 1).alias("caption"), F.lit(None).cast("string").alias("post_url")))


def user_name(raw: Column) -> Column:
    """Without blanks at the ends and any @; null if nothing is left."""
    return F.nullif(F.replace(F.trim(raw), F.lit("@"), F.lit("")), F.lit(""))
