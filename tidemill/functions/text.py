"""Text functions as column expressions: normal form, tokens, shingles, slugs, HTML to text, sentences and summaries."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = ["the", "a", "an", "and", "or", "for", "to", "of", "in", "on", "with", "is", "are", "be", "as", "at", "by", "from", "that", "this", "it", "its", "ve", "ile", "bir", "bu", "de", "da", "için", "olarak"]
SPECIAL_LETTERS = {"ı": "i", "ğ": "g", "ş": "s", "ø": "o", "æ": "a", "ß": "s", "đ": "d", "ł": "l"}
# Keyword to category, first match wins.
CATEGORY_KEYWORDS = [
    ("llm", "Ai"), ("gpt", "Ai"), ("model", "Ai"), ("agent", "Ai"), ("transformer", "Ai"), ("open source", "OpenSource"), ("release", "Software"), ("version", "Software"), ("framework", "Software"),
    ("vulnerability", "Security"), ("cve", "Security"), ("security", "Security"), ("funding", "Startup"), ("startup", "Startup"), ("hiring", "Career"), ("paper", "Science"), ("arxiv", "Science"), ("gpu", "Hardware"), ("chip", "Hardware"),
]
DEFAULT_CATEGORY = "Software"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; without it, what a nested lambda names is evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


@cache
def _folding() -> tuple[str, str]:
    """Characters of the basic plane that decompose to one character and marks, and that character."""
    table = dict(SPECIAL_LETTERS)
    for cp in range(0xC0, 0x10000):
        c = chr(cp)
        if c in table or 0xD800 <= cp <= 0xDFFF:
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c:
            table[c] = SPECIAL_LETTERS.get(base, base)
    return "".join(table), "".join(table.values())


def _jamo(ch: Column) -> Column:
    """A Hangul syllable as the letters it is composed of."""
    i = F.ascii(ch) - 0xAC00
    unit = lambda x: F.lpad(F.hex(x.cast("long")), 4, "0")
    tail = F.when(i % 28 > 0, unit(F.lit(0x11A7) + i % 28)).otherwise(F.lit(""))
    return F.decode(F.unhex(F.concat(unit(F.lit(0x1100) + F.floor(i / 588)), unit(F.lit(0x1161) + F.floor(i % 588 / 28)), tail)), "UTF-16BE")


def normalize(text: Column) -> Column:
    """Lower case without marks; runs of anything but letters and decimal digits of the basic plane become one space.
    Null and blank give ''. Precomposed characters are folded by a constant table, so nothing leaves the JVM."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hangul = F.array_join(F.transform(F.split(lowered, ""), lambda ch: F.when(ch.between("가", "힣"), _jamo(ch)).otherwise(ch)), "")
    whole = F.when(lowered.rlike("[가-힣]"), hangul).otherwise(lowered)
    chars, to = _folding()
    folded = F.regexp_replace(F.translate(whole, chars, to), r"[\p{Mn}&&[\x{0}-\x{FFFF}]]", "")
    return F.trim(F.regexp_replace(folded, r"(?:[\x{10000}-\x{10FFFF}]|[^\p{L}\p{Nd}])+", " "))


def tokenize(normal: Column) -> Column:
    """Words of a normal form, without stop words and single characters."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(normal, " "), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def shingles(tokens: Column, size: int = 2) -> Column:
    """Sliding sequences of ``size`` tokens, space-joined; all as one if there are fewer, none of none. Best given a column,
    as it is read several times."""
    n = F.size(tokens)
    cut = F.slice(tokens, 1, F.greatest(n - size + 1, F.lit(1)))
    for k in range(2, size + 1):
        cut = F.zip_with(cut, F.slice(tokens, k, F.greatest(n - size + 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.array_join(tokens, " "))).otherwise(cut)


def slugify(normal: Column, most: int = 80) -> Column:
    """Normal form with dashes, cut at a dash if one lies past half of ``most`` characters."""
    slug = F.replace(normal, F.lit(" "), F.lit("-"))
    cut = F.substring(slug, 1, most)
    last = F.length(cut) - F.locate("-", F.reverse(cut))  # place from 0 of the last dash
    shortened = F.when((F.locate("-", cut) > 0) & (last > most // 2), F.substr(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(slug) <= most, slug).otherwise(shortened)


def slugify_unique(normal: Column, hex_id: Column, most: int = 72) -> Column:
    slug = slugify(normal, most)
    return F.when(slug == "", F.right(hex_id, F.lit(8))).otherwise(F.concat_ws("-", slug, F.right(hex_id, F.lit(8))))


def content_hash(normal: Column) -> Column:
    return F.upper(F.sha2(normal.cast("binary"), 256))


def _entity(e: Column) -> Column:
    """The character of an entity such as ``&amp;`` or ``&#x27;``; itself if unknown."""
    names = F.create_map(*[F.lit(x) for k, v in sorted(name2codepoint.items()) for x in (k, chr(v))], F.lit("apos"), F.lit("'"))
    body = F.substr(e, F.lit(2), F.length(e) - 2)
    hexed = F.when(body.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.substr(body, F.lit(3))).when(body.rlike("^#[0-9]{1,7}$"), F.hex(F.substr(body, F.lit(2)).cast("long")))
    known = F.conv(hexed, 16, 10).cast("long").between(1, 0x10FFFF) & ~F.conv(hexed, 16, 10).cast("long").between(0xD800, 0xDFFF)
    return F.coalesce(F.try_element_at(names, body), F.when(known, F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")), e)


def html_decode(text: Column) -> Column:
    """Named and numeric entities as characters, in one pass."""
    entity = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});"
    found = F.transform(F.regexp_extract_all(text, F.lit(entity), F.lit(0)), _entity)
    joined = F.array_join(F.zip_with(F.split(text, entity, -1), found, lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")
    return F.when(text.rlike(entity), joined).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Tags as word boundaries, white space collapsed, entities decoded; null if nothing is left. Text after an unclosed
    ``<`` is dropped, as is a stray ``>``; the inside of scripts stays."""
    untagged = F.replace(F.regexp_replace(html, r"<[^>]*(?:>|$)", " "), F.lit(">"), F.lit(""))
    plain = F.regexp_replace(html_decode(F.regexp_replace(untagged, r"(?U)\s+", " ")), r"(?U)^\s+|\s+$", "")
    return F.nullif(plain, F.lit(""))


def best_text(content: Column, excerpt: Column, title: Column) -> Column:
    """The first that isn't blank, untrimmed."""
    given = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(given(content), given(excerpt), title)


def sentences(text: Column) -> Column:
    """Parts between ``. ! ?`` and line ends that have more than 25 characters, each with a full stop."""
    parts = F.transform(F.split(text, r"[.!?\n]"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.transform(F.filter(parts, lambda s: F.length(s) > 25), lambda s: F.concat(s, F.lit(".")))


def category(normal: Column) -> Column:
    """Category of the first keyword, in list order, that the normal form holds as a substring."""
    return let(normal, lambda n: reduce(lambda rest, kv: F.when(n.contains(kv[0]), kv[1]).otherwise(rest), reversed(CATEGORY_KEYWORDS), F.lit(DEFAULT_CATEGORY)))


def reading_minutes(text: Column) -> Column:
    """200 words a minute, words cut at spaces only; 1 to 10."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != ""))
    return F.least(F.greatest(F.ceil(words / 200.0), F.lit(1)), F.lit(10)).cast("int")


def importance_estimate(sources: Column) -> Column:
    return F.least(F.greatest(0.3 + 0.1 * sources, F.lit(0.3)), F.lit(0.8))


def digest_intro(n: Column) -> Column:
    return F.when(n == 0, "Bugün öne çıkan bir gelişme yok.").when(n == 1, "Bugün tek bir gelişme öne çıkıyor.").otherwise(F.concat(F.lit("Bugün için "), n.cast("string"), F.lit(" gelişme seçildi.")))


def shorten(text: Column, most: int, trim_first: bool = False) -> Column:
    """First ``most`` characters; blank text is unchanged."""
    kept = F.trim(text) if trim_first else text
    return F.when(F.trim(text) == "", text).otherwise(F.substring(kept, 1, most))


def trust_band(score: Column) -> Column:
    return F.when(score >= 85, "Çok güvenilir").when(score >= 70, "Güvenilir").when(score >= 50, "Makul").when(score >= 30, "Temkinli yaklaş").otherwise("Doğrulanmamış")


def time_ago(then: Column, now: Column) -> Column:
    """Label of the age in minutes, hours or days, each rounded half up; day and month number from a week on."""
    half_up = lambda x: F.floor(x + 0.5)
    minutes = half_up((F.unix_micros(now) - F.unix_micros(then)) / 60e6)
    hours = half_up(minutes / 60)
    days = half_up(hours / 24)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(minutes < 1, "az önce").when(minutes < 60, said(minutes, " dk önce")).when(hours < 24, said(hours, " sa önce")).when(days < 7, said(days, " gün önce")).otherwise(F.date_format(then, "d.M."))


def percent_label(value: Column) -> Column:
    n = F.floor(value + 0.5)
    return F.concat(F.when(n > 0, "+").otherwise(""), n.cast("string"), F.lit("%"))


def redundant(text: Column, title: Column) -> Column:
    """Whether a text says no more than the title: empty, equal, or longer by under 12 characters."""
    bare = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    a, b = bare(text), bare(title)
    return F.coalesce((a == "") | (a == b) | (a.startswith(b) & (F.length(a) - F.length(b) < 12)), F.lit(True))
