"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. Its whole multiple of the source's words is taken of every document for
certain; the words that are left are the size of a sample in which a document is included with probability pi, one more
copy of it. Probabilities are unequal: pi is min(1, level * merit), where merit is a small whole number that grows with a
document's size (or a given weight) and the source's level makes the words of all pi sum to the sample's size. Documents
with pi of 1 are certain copies, set apart; the others are an order sample: they are ranked by random odds over inclusion
odds, (u / (1 - u)) / (pi / (1 - pi)), and the first ones are taken until the sample is full, so it has a fixed size.

Random numbers hang on the id, the text and the number of the copy: rows with equal ids and texts are numbered, so a source
that is mostly one repeated row is sampled like any other.

DataFrame operations only. A source may hold any share of the rows: words are summed by source and merit, ranks are cut
into slices by value, as many as the source has rows for, and only the slice in which the sample ends is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sieve, stored, word_count

#: Slices of a source's ranks at least, and rows of a slice on average, above which it has more.
SLICES, SLICE_ROWS = 4096, 4096
#: Copies of a row that are made together.
COPIES = 4096
#: A document's merit: one, and one more for each of these sizes that it reaches.
MERIT_SIZES = (100, 400, 1600)
_RANGE = 1 << 48


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys alone: 48 bits of an MD5 digest."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(_RANGE))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all words; no target is above
    ``most`` times its source's words, and the excess is shared again by weight. With sources ordered by size over
    weight, those at the limit come first, so sums along that order give the result without iteration.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size").withColumn("w", w)
    everything = Window.partitionBy()
    by_need = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "all_words": F.sum("source_size").over(everything),
        "full": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "left_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        "place": F.row_number().over(by_need),
    })
    level = (F.lit(share) * F.col("all_words") - F.lit(most) * F.col("full")) / F.col("left_w")
    s = s.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.lit(most) * F.col("source_size"))
    s = s.withColumn("first_free", F.min(F.when(F.col("free"), F.col("place"))).over(everything))
    s = s.withColumn("shared", F.max(F.when(F.col("place") == F.col("first_free"), F.col("level"))).over(everything))
    capped = F.col("first_free").isNull() | (F.col("place") < F.col("first_free"))
    return s.select("source", "source_size", F.when(capped, F.lit(float(most)) * F.col("source_size")).otherwise(F.col("shared") * F.col("w")).alias("target"))


def levels(by_merit: DataFrame) -> DataFrame:
    """(_source, _level) from (_source, _merit, _words, _rest): pi = min(1, _level * _merit) gives words of _rest in all. The
    greatest merits reach 1 first, so sums along that order give the level without iteration."""
    order = Window.partitionBy("_source").orderBy(F.desc("_merit"))
    before = F.coalesce(F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(F.col("_words") * F.col("_merit")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.when(after > 0, (F.col("_rest") - before) / after).otherwise(0.0)
    free = by_merit.withColumn("_level", level).filter(F.col("_level") * F.col("_merit") <= 1)
    return free.groupBy("_source").agg(F.max(F.struct("_merit", "_level"))["_level"].alias("_level"))


def numbered(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``_copy``: rows with equal id, source and text are numbered from 1. Most rows have no equal: only the
    others are aggregated, to distinct rows and their counts, and spread again, a chunk of COPIES at a time."""
    own = docs.withColumn("_equal", F.xxhash64(F.struct(id_col, source_col, text_col)))
    repeated = stored(own.groupBy("_equal").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").select("_equal"), "repeated")
    if repeated.isEmpty():
        return docs.withColumn("_copy", F.lit(1).cast("long"))
    maybe, clean = sieve(own, "_equal", repeated)
    several = maybe.join(repeated.hint("shuffle_hash"), "_equal", "left_semi")
    alone = clean.unionByName(maybe.join(repeated.hint("shuffle_hash"), "_equal", "left_anti")).withColumn("_copy", F.lit(1).cast("long"))
    distinct = several.groupBy(*several.columns).agg(F.count(F.lit(1)).alias("_m"))
    order = Window.partitionBy("_equal").orderBy(F.xxhash64(*docs.columns))
    first = distinct.withColumn("_first", F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_m"))
    chunks = first.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / COPIES)))).repartition("_equal", "_chunk")
    begin = F.col("_chunk") * COPIES
    spread = chunks.withColumn("_k", F.explode(F.sequence(begin + 1, F.least(begin + COPIES, F.col("_m"))))).withColumn("_copy", F.col("_first") + F.col("_k"))
    return alone.drop("_equal").unionByName(spread.select(*docs.columns, "_copy"))


def _ranks(sized: DataFrame, seed: str) -> DataFrame:
    """``_rank``: random odds over inclusion odds, as a number from 0 (certain) to 1 (never). ``_tie`` orders equal ones."""
    pi = F.least(F.coalesce(F.col("_level"), F.lit(1.0)) * F.col("_merit"), F.lit(1.0))
    u = uniform(F.lit(seed), F.col("_id"), F.col("_text"), F.col("_copy"))
    odds = (u / (1 - u)) * (1 - pi) / F.greatest(pi, F.lit(1e-12))
    return sized.withColumns({"_rank": odds / (1 + odds), "_tie": F.xxhash64("_id", "_text", "_copy")})


def source_plan(sized: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: str) -> DataFrame:
    """For (``_id``, ``_text``, ``_copy``, ``_source``, ``_size``, ``_merit``): one row for each source with its target, whole
    copies, level and the last rank (``_last``: rank, tie) that gets one more copy, null where none does."""
    by_merit = stored(sized.groupBy("_source", "_merit").agg(F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_rows")), "merits")  # a few rows for each source
    src = by_merit.groupBy("_source").agg(F.sum("_words").alias("source_size"), F.greatest(F.lit(SLICES), F.ceil(F.sum("_rows") / SLICE_ROWS)).alias("_slices"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = targets(src.withColumnRenamed("_source", "source"), weights, share, most).withColumnRenamed("source", "_source").withColumn("_whole", whole)
    goal = goal.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    goal = _with(goal, src.select("_source", "_slices"))
    goal = stored(_with(goal, levels(_with(by_merit, goal.select("_source", "_rest")))), "targets")
    ranked = _ranks(_with(sized, goal), seed).withColumn("_slice", F.floor(F.col("_rank") * F.col("_slices")).cast("int"))
    slices = ranked.groupBy("_source", "_slice", "_rest").agg(F.sum("_size").alias("_words"))
    run = slices.withColumn("_to", F.sum("_words").over(Window.partitionBy("_source").orderBy("_slice")))
    run = run.withColumn("_from", F.col("_to") - F.col("_words"))
    # the slice in which the sample ends; the last slice of all where every document fits
    cut = run.groupBy("_source").agg(
        F.coalesce(F.min(F.when(F.col("_to") > F.col("_rest"), F.struct("_slice", "_from"))), F.max(F.struct("_slice", "_from"))).alias("_cut")
    )
    cut = stored(cut.select("_source", F.col("_cut._slice").alias("_cut_slice"), F.col("_cut._from").alias("_cut_from")), "cuts")
    edge = _with(ranked, cut).filter((F.col("_slice") == F.col("_cut_slice")) & (F.col("_rest") > 0))
    inner = Window.partitionBy("_source").orderBy("_rank", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_before", F.col("_cut_from") + F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    taken = edge.filter(F.col("_before") + F.col("_size") / 2 <= F.col("_rest")).groupBy("_source").agg(F.max(F.struct("_rank", "_tie")).alias("_last"))
    # where not even the first document of that slice fits, all earlier slices are taken still
    plan = _with(_with(goal, cut), taken)
    return stored(plan.select("_source", "source_size", "target", "_whole", "_rest", "_slices", "_level", F.col("_cut_slice"), F.col("_last._rank").alias("_last_rank"), F.col("_last._tie").alias("_last_tie")), "mix-plan")


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the source, null included. ``right`` has one row for each source; Spark broadcasts it below its
    size threshold and else splits the skewed partitions of ``left``."""
    r = right.withColumnRenamed("_source", "_s")
    return left.join(r, left["_source"].eqNullSafe(r["_s"]), "left").drop("_s")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weight_col: str | None = None) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` (times the mix takes the document) and ``taken``
    (words the mix takes, ``size * copies``) added; columns of these names in ``docs`` are replaced.

    A null text has size 0, a null source is a source of its own, last in order. Documents of size 0 take 0 words. Rows
    with the same id, source and text are numbered, and a sample that ends among them takes a part; null ids are told by
    their texts. Columns must be of kinds that can be grouped. ``weight_col``: a positive number for each
    document in place of its size's merit, rounded to a whole power of the square root of two (null: 1). An empty table
    gives an empty result. Random numbers depend on ``seed``, the id, the text and the copy's number, so that reruns agree.
    """
    kept = docs.drop("size", "source_size", "target", "copies", "taken")
    name = {c: f"c{i}" for i, c in enumerate(kept.columns)}  # names that no added column has
    id_col, source_col, text_col, weight_col = name[id_col], name[source_col], name[text_col], name[weight_col] if weight_col else None
    base = numbered(kept.toDF(*name.values()), id_col, source_col, text_col)
    size = word_count(F.col(text_col))
    given = F.pow(F.lit(2.0), F.round(2 * F.log2(F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)))) / 2) if weight_col else None
    merit = given if weight_col else sum((F.when(F.col("_size") >= n, 1).otherwise(0) for n in MERIT_SIZES), F.lit(1))
    own = lambda df: df.withColumns({"_id": F.col(id_col), "_text": F.md5(F.coalesce(text_col, F.lit("")).cast("binary")), "_source": F.col(source_col), "_size": size}).withColumn("_merit", merit)
    sized = stored(own(base).select("_id", "_text", "_copy", "_source", "_size", "_merit"), "sizes")
    plan = source_plan(sized, weights, share, most, seed)
    out = _ranks(_with(own(base), plan), seed)
    at = F.floor(F.col("_rank") * F.col("_slices")).cast("int")
    earlier = (F.col("_rank") < F.col("_last_rank")) | ((F.col("_rank") == F.col("_last_rank")) & (F.col("_tie") <= F.col("_last_tie")))
    extra = (F.col("_rest") > 0) & ((at < F.col("_cut_slice")) | F.coalesce(earlier, F.lit(False)))
    copies = F.least(F.col("_whole") + extra.cast("long"), F.lit(most))
    return out.select(*(F.col(v).alias(c) for c, v in name.items()), F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, COALESCE(LEN(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
        ((('0x' || substr(md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || md5(COALESCE(text, '')) || ':' || row_number() OVER (PARTITION BY doc_id, source, text)), 1, 12))::BIGINT) + 0.5) / 281474976710656.0 AS u
    FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
o AS (SELECT *, SUM(source_size) OVER () AS all_words,
        COALESCE(SUM(source_size) OVER b, 0) AS full_words, SUM(w) OVER () - COALESCE(SUM(w) OVER b, 0) AS left_w,
        row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS place
    FROM w WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * all_words - 2 * full_words) / left_w AS level FROM o),
f AS (SELECT *, min(CASE WHEN level * w <= 2 * source_size THEN place END) OVER () AS first_free FROM l),
t AS (SELECT source, source_size, CASE WHEN first_free IS NULL OR place < first_free THEN 2.0::DOUBLE * source_size
        ELSE max(CASE WHEN place = first_free THEN level END) OVER () * w END AS target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
h AS (SELECT *, target - whole * source_size AS rest FROM g),
e AS (SELECT *, 1 + CASE WHEN size >= 100 THEN 1 ELSE 0 END + CASE WHEN size >= 400 THEN 1 ELSE 0 END + CASE WHEN size >= 1600 THEN 1 ELSE 0 END AS merit FROM d),
m AS (SELECT source, merit, SUM(size) AS words FROM e GROUP BY ALL),
v AS (SELECT m.source, merit, (rest - COALESCE(SUM(words) OVER (PARTITION BY m.source ORDER BY merit DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
        NULLIF(SUM(words * merit) OVER (PARTITION BY m.source ORDER BY merit DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
    FROM m JOIN h ON m.source IS NOT DISTINCT FROM h.source),
lv AS (SELECT source, arg_max(COALESCE(level, 0), merit) AS level FROM v WHERE COALESCE(level, 0) * merit <= 1 GROUP BY source),
r AS (SELECT e.doc_id, e.size, h.source_size, h.target, h.whole, h.rest, e.source, least(COALESCE(lv.level, 1) * e.merit, 1) AS pi,
        (u / (1 - u)) * (1 - least(COALESCE(lv.level, 1) * e.merit, 1)) / greatest(least(COALESCE(lv.level, 1) * e.merit, 1), 1e-12) AS odds
    FROM e JOIN h ON e.source IS NOT DISTINCT FROM h.source LEFT JOIN lv ON lv.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), doc_id NULLS LAST, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
    CAST(least(whole + CASE WHEN rest > 0 AND before_ + size / 2 <= rest THEN 1 ELSE 0 END, 2) * size AS BIGINT) AS taken
FROM c
"""
