"""SimHash near-duplicate groups.

1. Each text becomes a 64-bit fingerprint of its word shingles.
2. Equal fingerprints are grouped first, so a group of exact copies is one node from then on.
3. Distinct fingerprints are dealt into buckets: the 64 bits are cut into ``radius + k`` blocks; two fingerprints that
   differ in ``radius`` bits at most agree on at least ``k`` blocks, so a bucket for each choice of ``k`` blocks loses no
   link. ``k`` follows from the number of distinct fingerprints. A bucket of more than CROWDED members is dealt once more:
   of ``radius + 1`` parts of its other bits, two linked fingerprints agree on one at least.
4. Inside buckets a Gray-order hierarchical index finds the links: fingerprints are sorted by bucket and by their rank in
   the Gray code, runs of them become nodes that hold the bits all members share (mask and pattern) and their range of
   buckets, runs of nodes become upper nodes. Two nodes are compared by the bits that both have fixed; a pair of groups
   that already differs in more than ``radius`` of these, or has no bucket in common, is dropped as a whole, as is one
   whose members are linked already.
5. Buckets return a spanning star for each of their groups, not the pairs; the groups of all buckets are joined by
   alternating large-star and small-star steps, with the edges written to the shared folder after each round.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import get, hot_join, pieces, put, runs, sieve, stored

BITS = 64
#: Members of a node of the index.
RUN = 16
#: Average members of a bucket above which one more block has to agree; members above which a bucket is dealt once more.
BUCKET, CROWDED = 64, 1 << 14


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, repeats included; none of a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in w), np.int64, len(w))) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(w) > words:
        starts, ends = starts[: len(w) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def _majority(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def odd_sketch(distinct: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 64 to WIDEST slots, in words of 64 slots: at least two slots a shingle
    as long as that is not too wide. A shingle that is in one of two sets only turns one slot over, so sketches never differ
    in more slots than the sets do in shingles."""
    slots = min(WIDEST, 1 << max(6, (2 * len(distinct) - 1).bit_length()))
    odd = np.bincount((distinct & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


class Sketches:
    """Sketches of many sets, which may differ in width."""

    def __init__(self, packed: Iterable[bytes]) -> None:
        packed = list(packed)
        self.width = np.fromiter((len(b) // 8 for b in packed), np.int64, len(packed))
        self.start = np.cumsum(self.width) - self.width
        self.words = np.frombuffer(b"".join(packed), np.uint64)

    def _take(self, at: np.ndarray, own: int, width: int) -> np.ndarray:
        whole = self.words[self.start[at][:, None] + np.arange(own)]
        return np.bitwise_xor.reduce(whole.reshape(len(at), own // width, width), axis=1)  # a sketch of fewer slots

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Slots in which the sketches at places ``x`` differ from those at ``y``, in the narrower width of the two."""
        out = np.zeros(len(x), np.int64)
        both = self.width[x] << 32 | self.width[y]
        for b in np.unique(both).tolist():
            of = np.flatnonzero(both == b)
            wide = b >> 32, b & 0xFFFFFFFF
            step = max(1, SKETCHED // max(wide))
            for i in range(0, len(of), step):  # bounded memory
                part = of[i : i + step]
                one, other = (self._take(at[part], own, min(wide)) for at, own in zip((x, y), wide, strict=True))
                out[part] = np.bitwise_count(one ^ other).sum(axis=1)
        return out


def most_apart(least: float, sizes: np.ndarray) -> np.ndarray:
    """Shingles that are in one only of two sets with so many shingles together, at most, if their similarity is ``least``."""
    return sizes * ((1 - least) / (1 + least)) + 1e-6


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of one text, unsigned. Null is as empty; a text without words has 0."""
    return _majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint as a signed long) for each row, repeated rows and null ids included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, words) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(work, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each pattern in the sequence of Gray codes."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of connected parts after the links a-b; a label is the smallest index of its part."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def gray_pairs(x: np.ndarray, radius: int, open_: Callable[[int, np.ndarray, np.ndarray], np.ndarray] | None = None, bucket: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of links inside buckets of ``x``, which is in the order of ``bucket`` (one, if not given) and
    in Gray order inside each; arrays of bounded size. ``open_`` may drop pairs of nodes (their width in members and
    places) that need no search."""
    n = len(x)
    # levels[0]: single fingerprints; each upper level: runs of RUN nodes below, with the bits that all members share
    patterns, masks = [x], [np.full(n, ~np.uint64(0))]
    low = [np.zeros(n, np.int64) if bucket is None else bucket]
    high = [low[0]]
    while len(patterns[-1]) > RUN:
        p, m = patterns[-1], masks[-1]
        at = np.arange(0, len(p), RUN)
        ones, zeros = np.bitwise_and.reduceat(p & m, at), np.bitwise_and.reduceat(~p & m, at)
        patterns.append(ones)
        masks.append(ones | zeros)
        low.append(low[-1][at])
        high.append(high[-1][np.minimum(at + RUN, len(p)) - 1])

    def near(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        p, m = patterns[level], masks[level]
        return (high[level][i] >= low[level][j]) & (np.bitwise_count((p[i] ^ p[j]) & m[i] & m[j]) <= radius)

    def descend(level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """i <= j: pairs of nodes that may hold links."""
        if level == 0:
            yield i, j
            return
        below = len(patterns[level - 1])
        for at in range(0, len(i), 4096):  # bounded memory: so many pairs of nodes at a time
            a, b = i[at : at + 4096], j[at : at + 4096]
            if open_ is not None:
                keep = open_(RUN**level, a, b)
                a, b = a[keep], b[keep]
            k = np.arange(RUN)
            c = (a[:, None, None] * RUN + k[None, :, None] + 0 * k[None, None, :]).ravel()
            d = (b[:, None, None] * RUN + 0 * k[None, :, None] + k[None, None, :]).ravel()
            keep = (c < below) & (d < below) & ((c < d) if level == 1 else (c <= d))
            c, d = c[keep], d[keep]
            keep = near(level - 1, c, d)
            c, d = c[keep], d[keep]
            nearest = np.argsort(d - c, kind="stable")  # neighbours in Gray order first: most links are there
            yield from descend(level - 1, c[nearest], d[nearest])

    top = len(patterns) - 1
    i, j = np.triu_indices(len(patterns[top]), k=0 if top else 1)
    keep = near(top, i, j)
    i, j = i[keep], j[keep]
    if top:
        nearest = np.argsort(j - i, kind="stable")
        i, j = i[nearest], j[nearest]
    yield from descend(top, i, j)


def bucket_groups(fps: np.ndarray, radius: int, bucket: np.ndarray | None = None) -> np.ndarray:
    """For fingerprints (unsigned, distinct inside each bucket), the smallest index in the argument's order of each one's
    group in its bucket."""
    n = len(fps)
    order = np.argsort(gray_rank(fps), kind="stable")
    if bucket is not None:
        order = order[np.argsort(bucket[order], kind="stable")]
    label = np.arange(n)

    def open_(width: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if width >= n:
            return np.ones(len(a), bool)
        low, high = np.minimum.reduceat(label, np.arange(0, n, width)), np.maximum.reduceat(label, np.arange(0, n, width))
        return (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])  # groups linked already need no search

    for i, j in gray_pairs(fps[order], radius, open_, None if bucket is None else bucket[order]):
        label = _join_labels(label, i, j)
    out = np.empty(n, np.int64)
    least = np.full(n, n, np.int64)
    np.minimum.at(least, label, order)
    out[order] = least[label]
    return out


def bucket_nearest(fps: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints (unsigned), the place of each one's nearest other within ``radius``, the first of equals;
    its own place where there is none."""
    n = len(fps)
    order = np.argsort(gray_rank(fps), kind="stable")
    best = (np.full(n, radius + 1, np.int64) << 32) | np.arange(n)
    for i, j in gray_pairs(fps[order], radius):
        a, b = order[i], order[j]
        d = np.bitwise_count(fps[a] ^ fps[b]).astype(np.int64) << 32
        np.minimum.at(best, a, d | b)
        np.minimum.at(best, b, d | a)
    return best & 0xFFFFFFFF


def agreeing_blocks(n: int, radius: int) -> int:
    """How many blocks have to agree, so that n random fingerprints fill a bucket with BUCKET members at most."""
    k = 1
    while n / 2 ** (BITS * k // (radius + k)) > BUCKET and radius + k < BITS:
        k += 1
    return k


def block_masks(radius: int, k: int) -> list[int]:
    """For each choice of k of the radius + k blocks, the mask of their bits."""
    m = radius + k
    cut = [BITS * i // m for i in range(m + 1)]
    blocks = [((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in range(m)]
    return [sum(c) for c in combinations(blocks, k)]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first one, cut only where it changes."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        kept.append(cols)
        if len(cols[0]) and cols[0][0] != cols[0][-1]:  # all but the last group are whole
            cols = [np.concatenate(x) for x in zip(*kept, strict=True)]
            last = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1
            yield [x[:last] for x in cols]
            kept = [[x[last:] for x in cols]]
    if kept and sum(len(x[0]) for x in kept):
        yield [np.concatenate(x) for x in zip(*kept, strict=True)]


def _cut(mask: int, parts: int) -> list[int]:
    """The bits of a mask in so many parts of like size."""
    bits = [i for i in range(BITS) if mask >> i & 1]
    return [sum(1 << i for i in bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def star_edges(nodes: DataFrame, radius: int, n: int) -> DataFrame:
    """Edges (a, b), a < b as signed longs, that connect just what links of ``radius`` bits or fewer connect.

    A bucket's key is a hash of table and bits: should two buckets fall together, more is compared, nothing is lost.
    """
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    masks = block_masks(radius, agreeing_blocks(n, radius))
    every = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(signed(x)))).alias("v")) for t, x in enumerate(masks)]
    dealt = nodes.select("fp", F.inline(F.array(*every)))
    crowded = stored(dealt.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED), "crowded")
    if not crowded.isEmpty():
        parts = F.array(*[F.array(*[F.lit(signed(p)) for p in _cut(~x & ((1 << BITS) - 1), radius + 1)]) for x in masks])
        again = F.transform(F.element_at(parts, F.col("t") + 1), lambda p, i: F.xxhash64("v", i, F.col("fp").bitwiseAND(p)))
        marked = dealt.join(crowded, "v", "left")  # a crowded key's rows are many: Spark broadcasts the keys or splits the join's skew
        dealt = marked.select("fp", F.explode(F.when(F.col("n").isNull(), F.array("v")).otherwise(again)).alias("v"))
    together = dealt.select("v", "fp").repartition("v").sortWithinPartitions("v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, own in _whole_groups(batches):
            fp = own.view(np.uint64)
            label = bucket_groups(fp, radius, v)
            other = np.flatnonzero(label != np.arange(len(fp)))
            x, y = own[label[other]], own[other]
            both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1)
            both = both[:, both[0] != both[1]]
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return together.mapInArrow(work, "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge.

    Alternates large-star (larger neighbours move to the smallest neighbour) and small-star (smaller ones do) until the
    edges no longer change. Each round is written to the shared folder, so that a lost executor costs one round.
    """
    e = stored(edges.filter("a <> b"), "edges")
    before, n = None, e.count()
    while n:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.when(F.col("b") > F.col("a"), True)).alias("n"))
        large = hot_join(both.filter("b > a"), least, "a", "n", total=n).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small-star: every node's edge to a smaller neighbour goes to the smallest of these
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (
            hot_join(down, low, "u", "n", total=n).select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b")
            .unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
            .distinct()
        )
        e = stored(small, "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, n = now, now[0]
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest
    id that links of ``radius`` differing bits or fewer reach, its own included.

    Null texts are as empty ones, whose fingerprint is zero and is linked like any other. Repeated rows stay. A null id
    gets its group's id, null where the group has no other. An empty table gives an empty result. Other columns are not
    read.
    """
    fps = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    labels = _rooted(nodes, star_edges(nodes.select("fp"), radius, nodes.count()), "fp")
    out = hot_join(fps.select(id_col, "fp"), labels, "fp", "n")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _rooted(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(``node``, root, component_id, n) for each row of ``nodes`` (``node``, least, n)."""
    roots = connected(edges)
    rooted = stored(nodes.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node)), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("w"))
    return hot_join(rooted.select("root", node, "n"), least, "root", "w").select(node, "root", "component_id", "n")


#: Texts whose shingles are counted to put the frequent ones last; most shingles that are kept as frequent.
COUNTED, FREQUENT = 8192, 1 << 18
#: Most slots of a sketch. Wider ones rule more of the pairs of long texts out, but weigh more.
WIDEST = 4096
#: Partners that a set proposes first, the closest by fingerprint. Sets of a shared shingle above which they are dealt into blocks. Shingles of prefixes in a bucket. Sets
#: that are compared with another one in one group. Bytes of sets that are sent at once. Words of sketches that are compared at once.
PROPOSED, TOGETHER, PREFIXES, PARTNERS, SENT, SKETCHED = 8, 4096, 1 << 19, 256, 1 << 22, 1 << 17


def frequent_shingles(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles (sorted, unsigned) that three or more of about COUNTED distinct texts hold, how many do, and the number of
    these texts. They only decide an order: any order gives the same pairs, a good one with fewer comparisons."""
    every = max(1, docs.count() // COUNTED)
    some = docs.select(F.col(text_col).alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(every)) == 0).dropDuplicates(["t"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                held = [np.unique(shingle_hashes(t, words)) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *held]).view(np.int64))], ["x"])

    found = stored(some.mapInArrow(work, "x long").groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter("n > 2"), "counted")
    least, kept = 3, 0
    for r in sorted(found.groupBy("n").agg(F.count(F.lit(1)).alias("of")).collect(), reverse=True):  # COUNTED rows at most
        kept += r["of"]
        if kept > FREQUENT:
            least = r["n"] + 1
            break
    told = found.filter(F.col("n") >= least).toArrow()
    x, n = told["x"].to_numpy().view(np.uint64), told["n"].to_numpy()
    order = np.argsort(x)
    return x[order], n[order], some.count()


def shingle_prefix(distinct: np.ndarray, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set in the common order (frequent ones last): so many that two sets with a Jaccard
    similarity of ``least`` share one of them at least."""
    m = len(distinct)
    x, n = frequent
    count = np.zeros(m, np.int64)
    if len(x):
        at = np.minimum(np.searchsorted(x, distinct), len(x) - 1)
        count = np.where(x[at] == distinct, n[at], 0)
    return distinct[np.lexsort((distinct, count))[: m - math.ceil(least * m - 1e-9) + 1]] if m else distinct


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, text_hash, fp, m, node, odd) for each row. ``node`` is the hash of the set of distinct shingles, m its size,
    ``odd`` its sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                rows = []
                for t in b.column(2).to_pylist():
                    h = shingle_hashes(t, words)
                    u = np.unique(h)
                    rows.append((_majority(h), len(u), xxhash.xxh64_intdigest(u.tobytes()), odd_sketch(u).tobytes()))
                fp, m, node, odd = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(m, pa.int64()), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(odd, pa.binary())],
                    ["id", "text_hash", "fp", "m", "node", "odd"],
                )

    kind = dict(docs.dtypes)[id_col]
    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t"))
    return read.mapInArrow(work, f"id {kind}, text_hash long, fp long, m long, node long, odd binary")


def nearest_together(starts: np.ndarray, sizes: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Place of a member of the same group with a fingerprint close by: the closest in a group of BUCKET members, in a
    larger one the closest in a stretch of 1024 in Gray order."""
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    label, best = np.arange(len(fp)), np.full(len(fp), BITS + 1, np.int64)
    at, shift = np.flatnonzero(np.repeat(sizes <= BUCKET, sizes)), 1
    while len(at):  # all small groups at once: each member with the one so many places on
        at = at[at + shift < len(fp)]
        at = at[bucket[at] == bucket[at + shift]]
        d = np.bitwise_count(fp[at] ^ fp[at + shift]).astype(np.int64)
        for own, other in ((at, at + shift), (at + shift, at)):
            closer = d < best[own]
            best[own[closer]], label[own[closer]] = d[closer], other[closer]
        shift += 1
    for s, size in zip(starts[sizes > BUCKET].tolist(), sizes[sizes > BUCKET].tolist(), strict=True):
        order = s + np.argsort(gray_rank(fp[s : s + size]), kind="stable")
        for i in range(0, size, 1024):
            part = order[i : i + 1024]
            label[part] = part[bucket_nearest(fp[part], BITS)]
    return label


_PREFIX = "bucket long, token binary, place binary, owner binary, node binary, m binary, fp binary"


def shared_shingles(docs: DataFrame, text_col: str, words: int, least: float, frequent: tuple[np.ndarray, np.ndarray], sampled: int, n: int, size: int) -> DataFrame:
    """(token, node, m, place, near, apart): the sets that share a shingle of their prefixes with a set of like size;
    ``near`` is another set with that shingle, whose fingerprint is ``apart`` bits away. Of ``n`` texts with ``size`` bytes.

    Prefixes are shuffled as arrays, by bucket of shingle and with each distinct set of a block of texts once. A shingle is
    told by 48 bits; a false match is one more pair to check. Shingles of a large part of the sample are dealt over
    several buckets, in another way for each shingle, so that a family which holds any share of all rows is linked by
    some of its shingles; all sets with such a shingle are given, as one that is alone in its bucket may have a partner in
    another one, which it meets where sets are put together by shingle again."""
    buckets = max(1, math.ceil(size / 6 * (1 - least) / PREFIXES))
    some, count = frequent
    hot, slices = some[count * n > sampled * CROWDED], (count[count * n > sampled * CROWDED] * n // (sampled * CROWDED) + 1).astype(np.uint64)
    sliced = hot >> np.uint64(16)

    def mixed(x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> np.uint64(29))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x

    def packed(sets: dict[int, tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        node, m, fp = np.array(list(sets), np.uint64), np.array([x[0] for x in sets.values()], np.uint32), np.array([x[1] for x in sets.values()], np.uint64)
        sizes = np.array([len(x[2]) for x in sets.values()], np.int32)
        token = np.concatenate([np.empty(0, np.uint64), *(x[2] for x in sets.values())])
        sets.clear()
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        place = np.arange(len(token), dtype=np.int32) - np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes, sizes)
        deal = token >> np.uint64(16)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
            split = hot[at] == token
            deal = np.where(split, mixed(token ^ (mixed(node[owner] ^ token) % slices[at])), deal)
        deal = mixed(deal)
        deal >>= np.uint64(32)
        deal *= np.uint64(buckets)
        deal >>= np.uint64(32)
        bucket = deal.astype(np.uint32)
        del deal
        order = np.lexsort((token, bucket))
        bucket, token, owner, place = bucket[order], token[order], owner[order], place[order]
        rows = []
        for key, a, b in runs(bucket):
            here, own = np.unique(owner[a:b], return_inverse=True)
            rows.append((key, put(token[a:b] >> np.uint64(16), np.uint64), put(place[a:b], np.uint32), put(own, np.uint32), put(node[here], np.uint64), put(m[here], np.uint32), put(fp[here], np.uint64)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), *[pa.binary()] * 6], strict=True)], [x.split()[0] for x in _PREFIX.split(", ")])

    def sent(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return pieces(batch, max(1, batch.num_rows * SENT // max(1, batch.nbytes)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, tuple[int, int, np.ndarray]] = {}
        held = 0
        for b in (piece for whole in batches for piece in pieces(whole)):
            for t in b.column(0).to_pylist():
                h = shingle_hashes(t, words)
                u = np.unique(h)
                node = xxhash.xxh64_intdigest(u.tobytes())
                if node not in sets:
                    sets[node] = (len(u), _majority(h), shingle_prefix(u, least, frequent))
                    held += len(sets[node][2])
                if held > PREFIXES:
                    yield from sent(packed(sets))
                    held = 0
        if sets:
            yield from sent(packed(sets))

    def find(t: pa.Table) -> pa.Table:
        each = lambda k, kind: [get(x, kind) for x in t[k].to_pylist()]  # noqa: E731  a column at a time
        token = np.concatenate(each("token", np.uint64))
        order = np.argsort(token, kind="stable")
        token = token[order]
        again = token[1:] == token[:-1]
        keep = np.concatenate((again, [False])) | np.concatenate(([False], again)) | np.isin(token, sliced)  # most shingles are in one set only
        order, token = order[keep], token[keep]
        node = each("node", np.uint64)
        start = np.cumsum([0, *map(len, node[:-1])])
        owner = np.concatenate([own.astype(np.int64) + at for own, at in zip(each("owner", np.uint32), start, strict=True)])[order]
        place = np.concatenate(each("place", np.uint32))[order].astype(np.int32)
        node, m, fp = np.concatenate(node)[owner], np.concatenate(each("m", np.uint32))[owner].astype(np.int64), np.concatenate(each("fp", np.uint64))[owner]
        order = np.lexsort((node, m, token))
        token, place, node, m, fp = (x[order] for x in (token, place, node, m, fp))
        keep = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))[: len(token)]  # copies in several blocks
        token, place, node, m, fp = (x[keep] for x in (token, place, node, m, fp))
        like = (token[1:] == token[:-1]) & (m[:-1] + 1e-9 >= least * m[1:])  # sorted by size: with the next one
        keep = (np.concatenate((like, [False])) | np.concatenate(([False], like)))[: len(token)] | np.isin(token, sliced)
        token, place, node, m, fp = (x[keep] for x in (token, place, node, m, fp))
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(token)))
        near = nearest_together(starts, sizes, fp)
        apart = np.bitwise_count(fp ^ fp[near]).astype(np.int32)
        return pa.table({"token": token.view(np.int64), "node": node.view(np.int64), "m": m, "place": place, "near": node[near].view(np.int64), "apart": apart})

    dealt = docs.select(F.col(text_col).alias("t")).mapInArrow(pack, _PREFIX)
    return dealt.groupBy("bucket").applyInArrow(find, "token long, node long, m long, place int, near long, apart int")


def crossing_pairs(shared: DataFrame, nodes: DataFrame, roots: DataFrame, least: float, bound: bool = True, closest: bool = False) -> DataFrame:
    """(a, b), a < b: all pairs of ``shared`` in different components that ``least`` does not rule out by the sizes of the
    sets, by what is left of them after the shared shingle and, with ``bound``, by their sketches. With ``closest`` a set has
    only the one of them with the closest sketch, and two components have one pair. Sets of a shingle that is in more than
    TOGETHER of them are dealt into blocks, and each pair of blocks is a group of its own."""
    rooted = shared.select("token", "node", "m", "place").join(roots.hint("shuffle_hash"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("blocks")).filter("x <> y").select("token", "blocks")
    own = F.pmod(F.xxhash64("node", "token"), F.col("blocks")).cast("int")
    dealt = rooted.join(several.hint("shuffle_hash"), "token").withColumn("own", own).join(nodes.select("node", "odd"), "node")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("v")
    dealt = dealt.select(key, "m", "node", "root", "place", "own", F.col("own").eqNullSafe(F.col("other")).cast("int").alias("same"), "odd")
    of_both = least / (1 + least)

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """Nodes and roots of whole groups, and places of the pairs that may be similar with the slots they differ in; None after the last."""
        for v, m, node, root, place, own, same, odd in _whole_groups(batches):
            sketches, left = Sketches(odd), m - place
            at, shift = np.arange(len(v)), 1
            while len(at):  # all groups at once: each set with the one so many places on, until that is too large
                at = at[at + shift < len(v)]
                to = at + shift
                at = at[(v[at] == v[to]) & (m[at] + 1e-9 >= least * m[to])]
                to = at + shift
                found = (root[at] != root[to]) & ((own[at] != own[to]) | ((same[at] & same[to]) == 1)) & (np.minimum(left[at], left[to]) + 1e-9 >= of_both * (m[at] + m[to]))
                x, y = at[found], to[found]
                if len(x):
                    d = sketches.apart(x, y)
                    close = d <= most_apart(least, m[x] + m[y]) if bound else np.ones(len(x), bool)
                    yield node, root, np.stack((x[close], y[close])), d[close]
                shift += 1
            yield node, root, None, None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        held = 0
        for node, _, places, _ in pairs_of(batches):
            if places is not None:
                x, y = node[places]
                kept.append(np.stack((np.minimum(x, y), np.maximum(x, y))))
                held += len(x)
            if held and (places is None or held > 1 << 17):
                a, b = np.concatenate(kept, axis=1)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])
                kept, held = [], 0

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for node, root, places, d in pairs_of(batches):
            best = np.full(len(node), np.iinfo(np.int64).max) if best is None else best
            if places is not None:
                np.minimum.at(best, places[0], d << 32 | places[1])
                np.minimum.at(best, places[1], d << 32 | places[0])
                continue
            own = np.flatnonzero(best < np.iinfo(np.int64).max)
            other, d = best[own] & 0xFFFFFFFF, best[own] >> 32
            cols = [node[own], d, np.minimum(node[own], node[other]), np.maximum(node[own], node[other]), np.minimum(root[own], root[other]), np.maximum(root[own], root[other])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["node", "d", "a", "b", "r", "s"])
            best = None

    together = dealt.repartition("v").sortWithinPartitions("v", "m")
    if not closest:
        return together.mapInArrow(each, "a long, b long").distinct()
    found = together.mapInArrow(nearest, "node long, d long, a long, b long, r long, s long")
    found = found.groupBy("node").agg(F.min(F.struct("d", "a", "b", "r", "s")).alias("p")).select("p.*")
    return found.groupBy("r", "s").agg(F.min(F.struct("d", "a", "b")).alias("p")).select("p.a", "p.b")


def maybe_similar(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sizes and sketches do not rule a similarity of ``least`` out."""
    about = nodes.select("node", "m", "odd")
    both = pairs.join(about.withColumnsRenamed({"node": "a", "m": "ma", "odd": "x"}).hint("shuffle_hash"), "a").join(about.withColumnsRenamed({"node": "b", "m": "mb", "odd": "y"}).hint("shuffle_hash"), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes = batch.num_rows, batch.column(2).to_numpy() + batch.column(3).to_numpy()
            sketches = Sketches(batch.column(4).to_pylist() + batch.column(5).to_pylist())
            close = sketches.apart(np.arange(n), n + np.arange(n)) <= most_apart(least, sizes)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(close)) for c in batch.columns[:2]], ["a", "b"])

    return both.select("a", "b", "ma", "mb", "x", "y").mapInArrow(work, "a long, b long")


def similar_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets of shingles have a Jaccard similarity of ``least`` or more. Each set is made of
    one of its texts again and sent, once, to each group in which it is compared; a group is one set with some of its
    partners. Shingles are told by 48 bits."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("g"))
    goes = dealt.select(F.col("a").alias("node"), F.struct("g", F.lit(True).alias("first")).alias("to")).unionByName(dealt.select(F.col("b").alias("node"), F.struct("g", F.lit(False).alias("first")).alias("to")))
    ends = stored(goes.groupBy("node").agg(F.collect_set("to").alias("to")).join(nodes.select("node", "rep.id", "rep.text_hash"), "node"), "ends")
    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t"))
    maybe, rest = sieve(read, "id", ends.select("id"))
    once = lambda df: df.groupBy("id", "text_hash").agg(F.first("t").alias("t"))
    asked = once(maybe).join(ends.hint("shuffle_hash"), ["id", "text_hash"]).select("t", "node", "to")
    if not ends.filter("id IS NULL").isEmpty():
        asked = asked.unionByName(once(rest.filter("id IS NULL")).drop("id").join(ends.filter("id IS NULL").drop("id"), "text_hash").select("t", "node", "to"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], ["g", "first", "node", "s"])

        rows, held = [], 0
        for b in (piece for whole in batches for piece in pieces(whole, 256)):
            for t, node, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                u = np.unique(shingle_hashes(t, words))
                if xxhash.xxh64_intdigest(u.tobytes()) == node % (1 << BITS):
                    short = u >> np.uint64(16)
                    own = put(np.diff(short, prepend=np.uint64(0)), np.uint64)
                    for x in to:
                        rows.append((x["g"], x["first"], node, own))
                        held += len(own) + 32
                        if held > SENT:
                            yield sets(rows)
                            rows, held = [], 0
        if rows:
            yield sets(rows)

    def compare(t: pa.Table) -> pa.Table:
        rows = {(f, n): np.cumsum(get(s, np.uint64)) for f, n, s in zip(t["first"].to_pylist(), t["node"].to_pylist(), t["s"].to_pylist(), strict=True)}
        ((a, x),) = [(n, s) for (f, n), s in rows.items() if f]
        good = []
        for (f, b), y in rows.items():
            if not f:
                at = np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))
                shared = int((x[at] == y).sum()) if len(x) else 0
                if shared + 1e-9 >= least * (len(x) + len(y) - shared):
                    good.append(b)
        return pa.table({"a": pa.array([a] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    sent = asked.mapInArrow(work, "g long, first boolean, node long, s binary")
    return stored(sent.groupBy("g").applyInArrow(compare, "a long, b long"), "links")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, bound: bool = True) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, fp, node) for each row of ``docs``, and (node, root, component_id, n) for each distinct set of
    shingles: ``root`` is equal for sets that links reach, where a link is a similarity of ``least`` or more.

    No link is lost: two similar sets share one of the first shingles of each in any common order (a prefix-filter join).
    1. Sets that share such a shingle each propose those with the closest fingerprints, which links most near copies.
    2. Of what is in different components then, each set proposes the one with the closest sketch.
    3. All pairs between the components so far that share such a shingle are checked.
    Pairs whose sketches differ in more slots than similar sets do in shingles are left out in each step, which is exact;
    without ``bound`` all are compared.
    """
    own = stored(_sets(docs, id_col, text_col, words), "sets")
    rep = F.min(F.struct(F.col("id").isNull().alias("_z"), "id", "text_hash")).alias("rep")
    nodes = stored(own.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), rep, *(F.first(c).alias(c) for c in ("m", "odd"))), "nodes")
    *frequent, sampled = frequent_shingles(docs, text_col, words)
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    shared = stored(shared_shingles(docs, text_col, words, least, tuple(frequent), max(1, sampled), n, size), "shared")
    near = shared.filter("node <> near").groupBy("node").agg(F.slice(F.array_sort(F.collect_set(F.struct("apart", "near"))), 1, PROPOSED).alias("p"))
    first = near.select("node", F.explode("p.near").alias("near")).select(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")).distinct()
    first = stored(maybe_similar(first, nodes, least) if bound else first, "proposed")
    check = lambda pairs: similar_pairs(pairs, nodes, docs, id_col, text_col, words, least)
    links, tried = check(first), first
    for closest in (True, False):
        more = crossing_pairs(shared, nodes, connected(links), least, bound, closest).join(tried.hint("shuffle_hash"), ["a", "b"], "left_anti")
        more = stored(more, "crossing")
        links, tried = links.unionByName(check(more)), tried.unionByName(more)
    return own.select("id", "text_hash", "fp", "node"), _rooted(nodes.select("node", "least", "n"), links, "node")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, bound: bool = True) -> DataFrame:
    """As ``near_duplicates``, but a link is a Jaccard similarity of ``least`` or more of the sets of word shingles (texts
    without words are equal)."""
    own, labels = similar_sets(docs, id_col, text_col, words, least, bound)
    out = hot_join(own, labels, "node", "n")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
