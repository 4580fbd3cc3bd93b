"""Approximate nearest neighbours over learned partitions.

Fitting uses a sample of SAMPLE vectors: its neighbour graph is cut into balanced parts (spectral bisection, then moves
that keep the parts' sizes), and a small network learns, from a vector, in which parts its neighbours are. A part with
more than CROWDED rows is cut again in the same way, from a sample of its own rows and with a network of its own, so that
parts grow with the table (fitted in a task for each such part). Every vector is indexed in the part the networks find
most probable; a query goes to the most probable parts, as many as reach RECALL on held-out sample vectors, and the
vectors there are ranked by their exact inner product. Neighbouring parts share a shelf of about BLOCK rows, which a query
visits once for all its parts on it; a part larger than that is a shelf of many blocks, so that a part that holds most of
the rows is many tasks.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE, NEIGHBOURS, HIDDEN = 8192, 10, 128
#: Vectors in a part at least, on average; most parts that one network tells apart; vectors of a part that is cut again.
PART_ROWS, MOST_PARTS, CROWDED = 50, 128, 8192
#: Part of the neighbours of held-out vectors that the chosen number of parts holds.
RECALL = 0.92
#: Rows of a block of candidates, and of queries.
BLOCK = 8192


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by inner product."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 1.1) -> np.ndarray:
    """A part for each node; parts is a power of two. Edges inside parts are kept many and sizes near equal."""
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    part = np.zeros(n, np.int64)
    rng = np.random.default_rng(5)
    for _ in range(int(math.log2(parts))):
        inside = part[a] == part[b]
        i, j = a[inside], b[inside]
        degree = np.bincount(i, minlength=n) + 1.0
        v = rng.standard_normal(n)
        for _ in range(60):  # towards the second eigenvector of each part
            size = np.bincount(part, weights=degree)
            v -= (np.bincount(part, weights=v * degree) / size)[part]
            v = (np.bincount(i, weights=v[j], minlength=n) + v) / degree
            v /= np.sqrt(np.bincount(part, weights=v * v) + 1e-30)[part]
        order = np.lexsort((v, part))
        rank = np.empty(n, np.int64)
        first = np.searchsorted(part[order], part[order])
        rank[order] = np.arange(n) - first
        part = 2 * part + (2 * rank >= np.bincount(part)[part])
    cap = math.ceil(slack * n / parts)
    for _ in range(4):
        near = np.zeros((n, parts), np.int32)
        np.add.at(near, (a, part[b]), 1)
        gain = near.max(axis=1) - near[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        for x in np.argsort(-gain, kind="stable"):
            if gain[x] <= 0:
                break
            to = int(near[x].argmax())
            if size[to] < cap:
                size[part[x]] -= 1
                size[to] += 1
                part[x] = to
    return part


def shelves(size: np.ndarray) -> np.ndarray:
    """The shelf of each part: parts in order share one while they have at most BLOCK rows together."""
    out, shelf, rows = np.zeros(len(size), np.int64), 0, 0
    for part, n in enumerate(size.tolist()):
        if rows and rows + n > BLOCK:
            shelf, rows = shelf + 1, 0
        out[part] = shelf
        rows += n
    return out


@dataclass
class Router:
    """A network with one hidden layer; gives the logarithm of each part's weight."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, epochs: int = 30) -> Router:
    """Cross entropy with the share of neighbours in each part, by Adam."""
    rng = np.random.default_rng(11)
    d, m = x.shape[1], target.shape[1]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    p = [rng.standard_normal((d, HIDDEN)) * math.sqrt(2 / d) * 2, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, m)) / math.sqrt(HIDDEN), np.zeros(m)]
    first, second, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            k = order[i : i + 128]
            h = x[k] @ p[0] + p[1]
            r = np.maximum(h, 0)
            z = r @ p[2] + p[3]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            g = (q / q.sum(axis=1, keepdims=True) - target[k]) / len(k)
            gh = (g @ p[2].T) * (h > 0)
            step += 1
            for n, grad in enumerate((x[k].T @ gh, gh.sum(axis=0), r.T @ g, g.sum(axis=0))):
                first[n] = 0.9 * first[n] + 0.1 * grad
                second[n] = 0.999 * second[n] + 0.001 * grad * grad
                p[n] -= 0.003 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def fit_router(sample: np.ndarray, parts: int, k: int, recall: float = RECALL) -> Router:
    """Parts, network and number of probes from the sample; every tenth vector only measures recall."""
    d = sample.shape[1]
    if parts == 1 or len(sample) < 4 * parts:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    test, x = sample[::10], np.delete(sample, np.s_[::10], axis=0)
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), part), 1)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1)
    router = train_router(x, target / target.sum(axis=1, keepdims=True))
    home = router.scores(x).argmax(axis=1)
    rank = np.argsort(np.argsort(-router.scores(test), axis=1), axis=1)
    near = np.argpartition(-(test @ x.T), min(k, len(x) - 1), axis=1)[:, :k]
    need = np.sort(rank[np.arange(len(test))[:, None], home[near]].ravel())
    router.probes = int(need[min(len(need) - 1, math.ceil(recall * len(need)))]) + 1
    return router


@dataclass
class Index:
    """A router over parts and, for parts that are cut again, one over their own parts. Leaves are numbered through."""

    top: Router
    below: dict[int, Router]

    def __post_init__(self) -> None:
        count = [len(self.below[p].b2) if p in self.below else 1 for p in range(len(self.top.b2))]
        self.first = np.concatenate(([0], np.cumsum(count)))

    @property
    def leaves(self) -> int:
        return int(self.first[-1])

    def home(self, x: np.ndarray) -> np.ndarray:
        part = self.top.scores(x).argmax(axis=1)
        leaf = self.first[part]
        for p, router in self.below.items():
            own = np.flatnonzero(part == p)
            if len(own):
                leaf[own] += router.scores(x[own]).argmax(axis=1)
        return leaf

    def route(self, x: np.ndarray, size: np.ndarray, k: int) -> list[list[int]]:
        """Leaves for each vector; more than the usual number of parts where these hold ``k`` others too few."""
        order = np.argsort(-self.top.scores(x), axis=1)
        below = {p: np.argsort(-r.scores(x), axis=1)[:, : r.probes] for p, r in self.below.items()}
        out = []
        for i, parts in enumerate(order):
            leaves, held = [], 0
            for n, p in enumerate(parts.tolist()):
                if n >= self.top.probes and held > k:
                    break
                own = (self.first[p] + below[p][i]).tolist() if p in below else [int(self.first[p])]
                leaves += own
                held += int(size[own].sum())
            out.append(leaves if held > k else list(range(len(size))))
        return out


def fit_index(vectors: DataFrame, n: int, k: int, most_parts: int = MOST_PARTS, crowded: int = CROWDED) -> Index:
    """An index of ``n`` rows (id, v) of one width."""
    parts = 1 << max(0, min(int(math.log2(most_parts)), int(math.log2(max(1, n / PART_ROWS)))))
    sample = np.stack(_sampled(vectors, n).select("v").toPandas()["v"]).astype(np.float64)
    if n <= crowded:
        return Index(fit_router(sample, parts, k), {})
    each = math.sqrt(RECALL)  # of both levels together RECALL
    top = fit_router(sample, parts, k, each)
    placed = vectors.mapInArrow(_placed(Index(top, {})), "id long, v array<double>, part int")
    size = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect() if r["n"] > crowded}  # one row for each part
    if not size:
        return Index(top, {})
    share = F.lit(0.0)
    for p, m in size.items():
        share = F.when(F.col("part") == p, min(1.0, SAMPLE / m)).otherwise(share)
    some = placed.filter(F.pmod(F.xxhash64("id", "v", F.lit("below")), F.lit(1_000_003)) / 1_000_003.0 < share)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = np.stack(rows.sort_values("id")["v"]).astype(np.float64)
        cut = 1 << max(1, min(int(math.log2(most_parts)), math.ceil(math.log2(size[key[0]] / crowded))))
        r = fit_router(own, cut, k, each)
        return pd.DataFrame({"part": [key[0]], "router": [pickle.dumps((r.w1, r.b1, r.w2, r.b2, r.probes))]})

    found = some.groupBy("part").applyInPandas(fit, "part int, router binary").collect()  # a network of bounded size for each part
    return Index(top, {r["part"]: Router(*pickle.loads(r["router"])) for r in found})


def _sampled(vectors: DataFrame, n: int) -> DataFrame:
    """About SAMPLE rows, chosen by a hash, in the order of it: no more than these are sorted."""
    h = F.xxhash64("id", "v")
    return vectors.filter(F.pmod(h, F.lit(1_000_003)) / 1_000_003.0 < min(1.0, 1.2 * SAMPLE / max(n, 1))).orderBy(h, "id").limit(SAMPLE)


def _placed(index: Index):
    """mapInArrow that adds the leaf of each row (id, v)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(index.home(_matrix(b.column(1))).astype(np.int32))], ["id", "v", "part"])

    return work


def valid(v: Column, width: int | None = None) -> Column:
    """Whether a vector takes part: not null nor zero, no null or non-finite component, of the given width."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    return ok & (F.size(v) == width) if width else ok


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, most_parts: int = MOST_PARTS, crowded: int = CROWDED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every``, the ``k`` nearest found among all other rows by
    inner product in double precision, ties to the smaller id; all of them where there are fewer.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id. Vectors of
    different widths have no inner product, so each width is searched for itself. A repeated id is one query for each of
    its widths, by its smallest vector, and each of its rows is a candidate of the others. Other columns are not read. An
    empty table gives an empty result.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & valid(F.col("v")))
    widths = {r["w"]: r["n"] for r in own.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each width
    found = [_search(own.filter(F.size("v") == w), n, every, k, most_parts, crowded) for w, n in sorted(widths.items()) if n > 1]
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found) if found else empty


def _search(own: DataFrame, n: int, every: int, k: int, most_parts: int, crowded: int) -> DataFrame:
    index = fit_index(own, n, k, most_parts, crowded)
    parts = index.leaves
    indexed = stored(own.mapInArrow(_placed(index), "id long, v array<double>, part int"), "indexed")
    size = np.zeros(parts, np.int64)
    for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():  # one row for each part
        size[r["part"]] = r["n"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(index.route(_matrix(b.column(1)), size, k), pa.list_(pa.int32()))], ["id", "v", "parts"])

    queries = indexed.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    shelf = shelves(size)
    shelf_of = F.element_at(F.array(*[F.lit(int(x)) for x in shelf]), F.col("part") + 1)
    routed = stored(queries.mapInArrow(route, "id long, v array<double>, parts array<int>"), "routed")
    on_shelves = F.explode(F.array_distinct(F.transform("parts", lambda p: F.element_at(F.array(*[F.lit(int(x)) for x in shelf]), p + 1))))
    routed = routed.select("id", "v", "parts", on_shelves.alias("shelf"))
    count = int(shelf.max()) + 1
    asked = np.zeros(count, np.int64)
    for r in routed.groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).collect():  # one row for each shelf
        asked[r["shelf"]] = r["n"]
    held = np.bincount(shelf, weights=size, minlength=count)
    blocks = F.array(*[F.lit(max(1, math.ceil(x / BLOCK))) for x in held.tolist()])
    sets = F.array(*[F.lit(max(1, math.ceil(x / BLOCK))) for x in asked.tolist()])
    of = lambda a: F.element_at(a, F.col("shelf") + 1)
    dealt = lambda a: F.pmod(F.xxhash64("id"), of(a).cast("long")).cast("int")
    each = lambda a: F.explode(F.sequence(F.lit(0), of(a) - 1))
    left = routed.select("shelf", dealt(sets).alias("set"), each(blocks).alias("block"), "id", "v", "parts")
    right = indexed.withColumn("shelf", shelf_of).select("shelf", each(sets).alias("set"), dealt(blocks).alias("block"), "id", "v", "part")

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if q.num_rows and c.num_rows:
            qi, ci, cp = q["id"].to_numpy(), c["id"].to_numpy(), c["part"].to_numpy()
            qv, cv = _matrix(q["v"].combine_chunks()), _matrix(c["v"].combine_chunks())
            wanted = q["parts"].combine_chunks()
            here = [(p, np.flatnonzero(cp == p)) for p in np.unique(cp).tolist()]
            asks = np.zeros((len(qi), len(here)), bool)
            asker, leaf = np.repeat(np.arange(len(qi)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy()
            at = np.minimum(np.searchsorted([p for p, _ in here], leaf), len(here) - 1)
            stands = np.array([p for p, _ in here])[at] == leaf
            asks[asker[stands], at[stands]] = True
            for i in range(0, len(qi), 256):
                s = np.full((len(qi[i : i + 256]), len(ci)), -np.inf)
                for no, (_, at) in enumerate(here):
                    rows = np.flatnonzero(asks[i : i + 256, no])
                    s[np.ix_(rows, at)] = qv[i + rows] @ cv[at].T
                s[qi[i : i + 256, None] == ci[None, :]] = -np.inf
                at = min(k, s.shape[1]) - 1
                least = -np.partition(-s, at, axis=1)[:, at]
                for j in range(len(s)):
                    slack = 1e-9 * (1 + abs(least[j])) if np.isfinite(least[j]) else 0.0
                    near = np.flatnonzero((s[j] >= least[j] - slack) & (s[j] > -np.inf))
                    exact = (qv[i + j] * cv[near]).sum(axis=1)  # alike for alike vectors, wherever they stand
                    order = np.lexsort((ci[near], -exact))[:k]
                    out.append((np.full(len(order), qi[i + j]), ci[near[order]], exact[order]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    keys = ("shelf", "set", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
