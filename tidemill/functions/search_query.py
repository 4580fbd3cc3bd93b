"""Plain-language search queries as filters: a period, official sources only, and the words that are left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# TIME_PHRASES (phrase and days, the first match in this order wins), OFFICIAL (phrases that ask for official
# sources) and FILLERS (words that are no search words, removed one after another in this order).
TIME_PHRASES = [
    ("son uc ayda", 90), ("son uc ay", 90), ("son 3 ayda", 90), ("son 3 ay", 90), ("last three months", 90), ("last 3 months", 90), ("son bir ayda", 30), ("son bir ay", 30), ("gecen ay", 30), ("son ayda", 30), ("son ay", 30), ("bu ayda", 30), ("bu ay", 30),
    ("past month", 30), ("last month", 30), ("this month", 30), ("son bir haftada", 7), ("son bir hafta", 7), ("gecen hafta", 7), ("bu haftada", 7), ("bu hafta", 7), ("son hafta", 7), ("past week", 7), ("last week", 7), ("this week", 7),
    ("bugun", 1), ("today", 1), ("bu yilda", 365), ("bu yil", 365), ("son yil", 365), ("this year", 365),
]
OFFICIAL = ["resmi kaynak", "official source"]
FILLERS = ["haberlerini goster", "haberleri goster", "haberlerini", "haberleri", "haber", "cikan", "yayinlanan", "olan", "goster", "listele", "bul", "getir", "tum", "show me", "show all", "find all", "list all", "news about", "news", "all"]


def parse(normal: Column) -> Column:
    """struct<text, days, official_only> of a query in normal form. Phrases are removed as plain substrings; if nothing is
    left, the text is the whole query."""
    phrase = reduce(lambda rest, p: F.when(normal.contains(p[0]), p[0]).otherwise(rest), reversed(TIME_PHRASES), F.lit(None).cast("string"))
    days = reduce(lambda rest, p: F.when(normal.contains(p[0]), p[1]).otherwise(rest), reversed(TIME_PHRASES), F.lit(None).cast("int"))
    official = reduce(lambda a, b: a | b, [normal.contains(x) for x in OFFICIAL])
    blank = lambda t, x: F.replace(t, F.lit(x) if isinstance(x, str) else x, F.lit(" "))
    timed = F.when(phrase.isNull(), normal).otherwise(blank(normal, phrase))
    named = F.when(official, reduce(blank, OFFICIAL, timed)).otherwise(timed)
    left = F.trim(F.regexp_replace(reduce(blank, FILLERS, named), " +", " "))
    return F.struct(F.when(left == "", normal).otherwise(left).alias("text"), days.alias("days"), official.alias("official_only"))
