"""Packing sequences into padded batches with optimal length buckets.

Texts longer than ``max_len`` tokens are cut into pieces of that length, so every token is packed. The global histogram of
piece lengths has ``max_len`` rows at most, at any corpus size; dynamic programming over it chooses the ``buckets``
boundaries with the least padding in total. Inside a bucket pieces are put in random order and cut into batches of
``budget // boundary`` rows (one at least). Places inside a bucket come from counts by slice of the random order plus the
place inside the slice, so no task orders a whole bucket. Pieces that are equal in id, place and length are one row with a
count until they have their places, so that an id repeated any number of times, or none, fills no slice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count
from .mixing import uniform

MAX_LEN, BUCKETS, BUDGET = 2048, 8, 16384
#: Slices of the random order of a bucket at least, and pieces of a slice on average, above which there are more.
SLICES, SLICE_ROWS = 1024, 4096


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (each the longest length of its bucket, ascending) that minimise the padded size of all pieces.
    ``lengths`` ascending and positive. Among equal costs the earlier split is taken, from the last bucket back."""
    n = len(lengths)
    if not n:
        return []
    total = np.concatenate(([0], np.cumsum(counts.astype(np.int64))))
    far = np.iinfo(np.int64).max // 4
    cost = np.where(np.arange(n + 1) == 0, 0, far)
    choice = []
    for _ in range(min(buckets, n)):
        new, arg = np.full(n + 1, far), np.zeros(n + 1, np.int64)
        for i in range(1, n + 1):
            all_costs = cost[:i] + int(lengths[i - 1]) * (total[i] - total[:i])
            arg[i] = int(all_costs.argmin())
            new[i] = all_costs[arg[i]]
        choice.append(arg)
        cost = new
    out, i = [], n
    for arg in reversed(choice):
        out.append(int(lengths[i - 1]))
        i = int(arg[i])
    return out[::-1]


def pack(docs: DataFrame, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, seed: str = "pack") -> DataFrame:
    """One row for each piece: ``id_col``, ``chunk`` (from 0), ``n_tokens``, ``bucket`` (the length it is padded to) and
    ``batch`` (from 0, inside the bucket).

    ``tokens``: a column with the number of tokens of a document; by default its words. Null and empty texts give one
    piece of 0 tokens with null bucket and batch, as they need no place. Repeated rows are packed one by one, with equal
    places in the random order. An empty table gives an empty result. Other columns are not read.
    """
    n = F.coalesce(tokens.cast("long"), F.lit(0)) if tokens is not None else word_count(F.col(text_col))
    pieces = F.greatest(F.ceil(F.col("n") / max_len), F.lit(1)).cast("int")
    cut = docs.select(F.col(id_col), n.alias("n")).select(F.col(id_col), "n", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("chunk"))
    length = F.least(F.col("n") - F.col("chunk").cast("long") * max_len, F.lit(max_len)).cast("int")
    cut = cut.select(F.col(id_col), "chunk", length.alias("n_tokens")).groupBy(id_col, "chunk", "n_tokens").agg(F.count(F.lit(1)).alias("m"))
    cut = stored(cut.withColumn("u", uniform(F.lit(seed), F.col(id_col), F.col("chunk"))), "pieces")

    histogram = sorted((r["n_tokens"], r["c"]) for r in cut.filter("n_tokens > 0").groupBy("n_tokens").agg(F.sum("m").alias("c")).collect())  # max_len rows at most
    slices = max(SLICES, sum(c for _, c in histogram) // SLICE_ROWS)
    bounds = best_boundaries(np.array([x for x, _ in histogram], np.int64), np.array([c for _, c in histogram], np.int64), buckets)
    bucket = F.lit(None).cast("int")
    for b in reversed(bounds):
        bucket = F.when((F.col("n_tokens") > 0) & (F.col("n_tokens") <= b), F.lit(b)).otherwise(bucket)
    placed = cut.withColumn("bucket", bucket).withColumn("slice", F.floor(F.col("u") * slices).cast("int"))
    counts = placed.filter("bucket IS NOT NULL").groupBy("bucket", "slice").agg(F.sum("m").alias("c"))  # a row for each bucket and slice
    order = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0))).drop("c")
    inside = Window.partitionBy("bucket", "slice").orderBy("u", F.col(id_col).asc_nulls_last(), "chunk", "n_tokens")
    ranked = placed.filter("bucket IS NOT NULL").withColumn("place", F.coalesce(F.sum("m").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(before, ["bucket", "slice"])
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket"))).cast("long")
    copies = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    batch = F.floor((F.col("before") + F.col("place") + F.col("copy")) / rows).cast("long")
    out = ranked.withColumn("copy", copies).select(F.col(id_col), "chunk", "n_tokens", "bucket", batch.alias("batch"))
    empty = placed.filter("bucket IS NULL").withColumn("copy", copies)
    return out.unionByName(empty.select(F.col(id_col), "chunk", "n_tokens", "bucket", F.lit(None).cast("long").alias("batch")))


def oracle() -> str:
    layers = []
    for k in range(1, BUCKETS + 1):
        if k == 1:
            layers.append("b1 AS (SELECT i, 0 AS j, len_ * total AS cost FROM h WHERE i > 0)")
        else:
            layers.append(
                f"b{k} AS (SELECT i, min(j) AS j, min(cost) AS cost FROM (SELECT h.i, b.i AS j, b.cost + h.len_ * (h.total - g.total) AS cost, "
                f"min(b.cost + h.len_ * (h.total - g.total)) OVER (PARTITION BY h.i) AS best FROM h JOIN b{k - 1} b ON b.i < h.i JOIN h g ON g.i = b.i) WHERE cost = best GROUP BY i)"
            )
    last = f"(SELECT least({BUCKETS}, max(i)) FROM h)"
    # from the last bucket back; with fewer lengths than buckets, each length is a bucket
    back = [f"e{BUCKETS} AS (SELECT max(i) AS i FROM h)"]
    back += [f"e{k} AS (SELECT j AS i FROM b{k + 1} JOIN e{k + 1} USING (i))" for k in range(BUCKETS - 1, 0, -1)]
    ends = " UNION ".join(f"SELECT i FROM e{k}" for k in range(1, BUCKETS + 1))
    return rf"""
WITH n AS (SELECT doc_id, COALESCE(LEN(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM documents),
p AS (SELECT doc_id, CAST(unnest(range(0, greatest(CAST(ceil(n / {MAX_LEN}) AS BIGINT), 1))) AS INTEGER) AS chunk, n FROM n),
q AS (SELECT doc_id, chunk, CAST(least(n - chunk * {MAX_LEN}, {MAX_LEN}) AS INTEGER) AS n_tokens,
    ((('0x' || substr(md5('pack:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || chunk), 1, 12))::BIGINT) + 0.5) / 281474976710656.0 AS u FROM p),
c AS (SELECT n_tokens AS len_, count(*) AS c FROM q WHERE n_tokens > 0 GROUP BY n_tokens),
h AS (SELECT 0 AS i, 0 AS len_, 0 AS total UNION ALL
    SELECT row_number() OVER (ORDER BY len_) AS i, len_, CAST(SUM(c) OVER (ORDER BY len_) AS BIGINT) AS total FROM c),
{", ".join(layers)},
{", ".join(back)},
ends AS (SELECT i FROM ({ends}) WHERE {last} = {BUCKETS} UNION SELECT i FROM h WHERE i > 0 AND {last} < {BUCKETS}),
bounds AS (SELECT h.len_ AS bucket FROM h JOIN ends USING (i)),
m AS (SELECT q.*, (SELECT min(bucket) FROM bounds WHERE q.n_tokens > 0 AND bucket >= q.n_tokens) AS bucket FROM q)
SELECT doc_id, chunk, n_tokens, CAST(bucket AS INTEGER) AS bucket, CASE WHEN bucket IS NULL THEN NULL ELSE CAST(floor(
    (row_number() OVER (PARTITION BY bucket ORDER BY u, doc_id NULLS LAST, chunk, n_tokens) - 1) / greatest(1, floor({BUDGET} / bucket))) AS BIGINT) END AS batch
FROM m
"""
