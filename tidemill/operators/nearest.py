"""Exact nearest neighbours by cosine, with bounds that rule out most of the table where vectors gather.

Vectors are dealt to balls: the nearest of at most CENTRES vectors that serve as centres, with the largest angle to it as
the ball's radius. No vector of a ball is closer to a query than the angle to the centre less the radius. A query first
meets its own ball; the k-th best score there is one that the answer can't be below, so of the other balls only those
whose bound reaches it are visited. A visit is a product of two blocks of at most about BLOCK rows, and no block meets
one that its bound rules out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored

CENTRES, BLOCK = 256, 2048
_SLACK = 1e-9


def _width(v: Column) -> Column:
    """The width of a vector that has an angle to others; -1 for null, empty and zero ones, whose similarity is 0."""
    return F.when(v.isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0), F.size(v)).otherwise(-1)


def _matrix(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ centres.T, -1, 1))


def in_balls(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` (id, v, width) with ``ball``, the nearest centre of that width, and ``angle`` to it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = b.column("width").to_numpy()
            for w in np.unique(widths).tolist():
                own = b.filter(pa.array(widths == w))
                angle = _angles(_matrix(own.column("v")), centres[w])
                ball = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ball.astype(np.int32)), pa.array(angle[np.arange(len(ball)), ball])], [*own.schema.names, "ball", "angle"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(work, ", ".join(f"{c} {kinds[c]}" for c in vectors.columns) + ", ball int, angle double")


def _visits(held: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity): for each query the ``k`` best of each block of each ball it visits. ``asking``: query_id, q, width, ball."""
    count = lambda df, name: df.groupBy("width", "ball").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = F.broadcast(stored(count(held, "parts").join(count(asking, "sets"), ["width", "ball"]), "visits"))  # a row for each ball
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = F.xxhash64("width", "ball", "part", "set").alias("block")
    x = held.join(sizes, ["width", "ball"]).withColumn("part", part("id", "parts")).withColumn("set", every("sets")).select(block, "id", "v")
    y = asking.join(sizes, ["width", "ball"]).withColumn("set", part("query_id", "sets")).withColumn("part", every("parts")).select(block, "query_id", "q")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            ids, names = left["id"].to_numpy(), right["query_id"].to_numpy()
            v, q = (_matrix(t[c].combine_chunks()) for t, c in ((left, "v"), (right, "q")))
            score = _unit(q) @ _unit(v).T
            score[names[:, None] == ids[None, :]] = -np.inf
            least = np.partition(score, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(names), -2.0)
            a, b = np.nonzero(score >= np.maximum(least, -2)[:, None] - _SLACK)  # ties stay; the last digits are told by sums in order
            length = lambda m: np.sqrt(np.cumsum(m * m, axis=1)[:, -1])
            lv, lq = length(v), length(q)
            for i in range(0, len(a), 4096):
                r, c = a[i : i + 4096], b[i : i + 4096]
                out[0].append(names[r])
                out[1].append(ids[c])
                out[2].append(np.cumsum(v[c] * q[r], axis=1)[:, -1] / (lv[c] * lq[r]))
        cat = lambda x, kind: np.concatenate([np.empty(0, kind), *x]).astype(kind)
        return pa.table({"query_id": cat(out[0], np.int64), "id": cat(out[1], np.int64), "similarity": cat(out[2], np.float64)})

    return x.groupBy("block").cogroup(y.groupBy("block")).applyInArrow(best, "query_id long, id long, similarity double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)  # Spark ranks inside tasks first


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", centres: int = CENTRES) -> DataFrame:
    """(query_id, rank, id, similarity): the ``k`` nearest others by cosine, exactly, ties to the smaller id. Null, empty
    and zero vectors, and vectors of unequal widths, have a similarity of 0. ``queries``: query_id, query; ids are longs."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), _width(F.col(vector_col)).alias("width"))
    asked = stored(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").alias("q"), _width(F.col("query")).alias("width")), "queries")
    by_width = Window.partitionBy("width").orderBy("id")
    least = own.select("id", "width").withColumn("_k", F.row_number().over(by_width)).filter(F.col("_k") <= k + 1).collect()  # k + 1 ids of each width
    zero = F.lit(None).cast("array<long>")
    for w in {-1, *(r["width"] for r in least)}:
        ids = sorted(r["id"] for r in least if r["width"] != w or w < 0)[: k + 1]
        zero = F.when(F.col("width") == w, F.array(*[F.lit(i) for i in ids]).cast("array<long>")).otherwise(zero)
    widths = {r["width"] for r in least}
    other = sorted(r["id"] for r in least)[: k + 1]  # of a width that no vector has
    zero = F.coalesce(zero, F.array(*[F.lit(i) for i in other]).cast("array<long>"))
    found = asked.select("query_id", F.explode(zero).alias("id")).filter("id <> query_id").withColumn("similarity", F.lit(0.0))

    good = own.filter("width > 0")
    n = max(1, min(centres, int(good.count() ** 0.5)))
    chosen = good.orderBy(F.xxhash64("id"), "id").limit(n * max(1, len(widths - {-1}))).collect()
    middle = {w: _unit(np.array([r["v"] for r in chosen if r["width"] == w], float)) if any(r["width"] == w for r in chosen) else np.eye(1, w) for w in widths - {-1}}
    if middle:
        held = stored(in_balls(good, middle), "balls")
        radius = {w: np.full(len(m), -1.0) for w, m in middle.items()}
        for r in held.groupBy("width", "ball").agg(F.max("angle").alias("r")).collect():  # a row for each ball
            radius[r["width"]][r["ball"]] = r["r"]
        able = asked.filter(F.col("width").isin([*middle]))
        first = stored(_visits(held, _asking(able, middle, radius, None), k), "own-balls")
        enough = _ranked(first, k).filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("least"))
        rest = _visits(held, _asking(able.join(enough, "query_id", "left"), middle, radius, "least"), k)
        found = reduce(DataFrame.unionByName, [found, first, rest])
    return _ranked(found, k).select("query_id", "rank", "id", "similarity")


def _asking(queries: DataFrame, middle: dict[int, np.ndarray], radius: dict[int, np.ndarray], least: str | None) -> DataFrame:
    """(query_id, q, width, ball): each query with its nearest ball; with ``least``, a score, with all other balls that may
    hold something as good."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = b.column("width").to_numpy()
            for w in np.unique(widths).tolist():
                own = b.filter(pa.array(widths == w))
                angle = np.where(radius[w] >= 0, _angles(_matrix(own.column("q")), middle[w]), np.inf)  # empty balls are far
                near = angle.argmin(axis=1)
                if least is None:
                    row, ball = np.arange(len(near)), near
                else:
                    score = own.column(least).to_numpy(zero_copy_only=False)
                    bound = np.where(angle < np.inf, np.cos(np.minimum(np.maximum(0.0, angle - radius[w]), np.pi)), -np.inf)
                    visit = bound >= np.where(np.isnan(score), -2.0, score - _SLACK)[:, None]
                    visit[np.arange(len(near)), near] = False
                    row, ball = np.nonzero(visit)
                yield pa.RecordBatch.from_arrays([*(own.column(c).take(pa.array(row)) for c in ("query_id", "q", "width")), pa.array(ball.astype(np.int32))], ["query_id", "q", "width", "ball"])

    return queries.mapInArrow(work, f"query_id long, q {dict(queries.dtypes)['q']}, width int, ball int")
