"""A trie of conversations' prefixes.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. The fingerprint of
the first d turns is the polynomial sum of (hash of turn i) * BASE^i over i = 1..d, modulo two primes below 2^31. Sums of
that kind are running sums, so numpy scans a sorted table of turns, in ranges: a conversation that spans several ranges
takes what came before from their ends, which are two numbers a range.

Prefixes with one fingerprint are a group of candidates. Each group is verified turn by turn: a member's last turn, word
by word, and the group of its parent have to be those of the representative, the member with the smallest id. By
induction over depths the groups are nodes then. If a group isn't of one kind, all fingerprints get one more independent
number, which splits it, until every group is.

What a node sums over its subtree is summed over its members instead, each of which adds what is its own below: a deeper
node belongs to its smallest member. So the rollup to parents is one aggregation of turns, whatever the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, stored

PRIMES, BASE = (2147483647, 2147483629), 48271
#: Ids of a piece of a list that is hashed.
PIECE = 1 << 16
#: Characters of a role and a text that order ranges; inside a range the whole ones do.
KEY = 64


def turns_of(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of rows with an id; null roles and texts are empty."""
    own = table.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return own.filter("conv_id IS NOT NULL")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): turns by ``turn`` (null first; ties by role and text), from 1. Sorted in ranges, so that
    a conversation of any length is no single task's."""
    key = ["conv_id", F.col("turn").asc_nulls_first()]
    ranged = turns.repartitionByRange(*key, F.substring("role", 1, KEY), F.substring("text", 1, KEY)).sortWithinPartitions(*key, "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(0).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            pos = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv)))) + 1
            if conv[0] == last:
                pos[: first[1] if len(first) > 1 else len(conv)] += at
            last, at = conv[-1], int(pos[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(pos), *b.columns[1:]], ["conv_id", "part", "at", "role", "text"])

    local = stored(ranged.select("conv_id", "role", "text").mapInArrow(work, "conv_id long, part int, at long, role string, text string"), "turns")
    before = _carried(local, ["at"])
    return local.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("at_before", F.lit(0))).alias("pos"), "role", "text")


def _carried(local: DataFrame, last: list[str]) -> DataFrame:
    """(conv_id, part, ``last``_before...): for each range (``part``) in which a conversation goes on, the sums of the ranges
    before. At most two conversations of a range go on in another one, so this is bounded by the number of ranges."""
    ends = local.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("z"))
    over = ends.select(F.explode(F.array_distinct(F.array("a", "z"))).alias("conv_id")).groupBy("conv_id").count().filter("count > 1").select("conv_id")
    own = local.join(F.broadcast(over), "conv_id", "left_semi").groupBy("conv_id", "part").agg(*(F.max_by(c, "at").alias(c) for c in last))
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return own.select("conv_id", "part", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in last))


def rebuilt(conversations: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, depth, role, text): each conversation c as the first h turns of c - c % ``group`` (all if fewer, none if
    it is absent) and its own turns after its first h, where h is the CRC-32 of c in decimal modulo ``heads``; depths from
    1. A conversation without turns has one row with depth 0.

    A turn without an id is of no conversation. Only first turns are sent to other conversations, each to less than ``group`` of them."""
    own = numbered(turns_of(conversations))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    count = own.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumns({"h": h, "first": F.col("conv_id") - F.col("conv_id") % group})
    there = count.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    plan = count.join(there, "first", "left").withColumn("k", F.least("h", F.coalesce("n_first", F.lit(0))))
    plan = stored(plan.select("conv_id", "first", "n", "h", "k"), "rebuild")
    tail = own.join(plan.select("conv_id", "h", "k"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "role", "text")
    head = own.filter(F.col("pos") < heads).select(F.col("conv_id").alias("first"), "pos", "role", "text")
    head = head.join(plan.filter("k > 0").select("conv_id", "first", "k"), "first").filter("pos <= k").select("conv_id", F.col("pos").cast("long").alias("depth"), "role", "text")
    none = plan.filter("k = 0 AND n <= h").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("role"), F.lit("").alias("text"))
    return tail.unionByName(head).unionByName(none)


def powers(exponents: np.ndarray, prime: int) -> np.ndarray:
    """BASE to each of the exponents, modulo ``prime``."""
    out, square, left = np.ones(len(exponents), np.int64), BASE % prime, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square, left = square * square % prime, left >> 1
    return out


def prefixes(turns: DataFrame, width: int, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(conv_id, depth, bytes, fp, parent): bytes of the texts of the first ``depth`` turns, and fingerprints of these turns
    and of one fewer: ``width`` numbers each. ``turns`` as ``rebuilt`` gives them, without depths of 0."""
    hashes = [F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in range(width)]
    ranged = turns.select("conv_id", "depth", F.octet_length("text").cast("long").alias("size"), *hashes).repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    sums = ["bytes", *(f"s{k}_{i}" for k in range(width) for i in range(2))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, None
        for b in batches:
            if not b.num_rows:
                continue
            conv, depth = b.column(0).to_numpy(), b.column(1).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(conv))))
            out = []
            for c in range(len(sums)):
                if c:
                    prime = primes[(c - 1) % 2]
                    own = b.column(3 + (c - 1) // 2).to_numpy().view(np.uint64)
                    own = (own >> np.uint64(32) if c % 2 else own & np.uint64(0xFFFFFFFF)).astype(np.int64) % prime * powers(depth, prime) % prime
                else:
                    own = b.column(2).to_numpy()
                total = np.cumsum(own)
                total = total - (total - own)[first][run]
                if conv[0] == last:
                    total[run == 0] += held[c]
                out.append(total % primes[(c - 1) % 2] if c else total)
            last, held = conv[-1], [int(x[-1]) for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(conv), part, np.int32)), *map(pa.array, out)], ["conv_id", "at", "part", *sums])

    local = stored(ranged.mapInArrow(work, f"conv_id long, at long, part int, {', '.join(f'{c} long' for c in sums)}"), "prefix-sums")
    whole = local.join(F.broadcast(_carried(local, sums)), ["conv_id", "part"], "left")
    total = lambda c: F.col(c) + F.coalesce(f"{c}_before", F.lit(0))
    fp = lambda k: (total(f"s{k}_0") % primes[0]) * (1 << 31) + total(f"s{k}_1") % primes[1]
    return whole.select("conv_id", F.col("at").alias("depth"), total("bytes").alias("bytes"), F.array(*(fp(k) for k in range(width))).alias("fp"))


def _verified(turns: DataFrame, primes: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, bytes, fp) of each prefix, and its nodes: (depth, fp, parent, conv_id, n_convs)."""
    width = 1
    while True:
        found = stored(prefixes(turns, width, primes), "prefixes")
        up = found.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("fp").alias("parent"))
        rows = turns.join(found.select("conv_id", "depth", "fp"), ["conv_id", "depth"]).join(up, ["conv_id", "depth"], "left")
        rows = rows.withColumn("parent", F.coalesce("parent", F.array(*[F.lit(0).cast("long")] * width)))
        # members with the representative's turn and parent are one row here
        kinds = rows.groupBy("depth", "fp", "parent", "role", "text").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
        kinds = stored(kinds.drop("role", "text"), "kinds")
        if kinds.groupBy("depth", "fp").count().filter("count > 1").isEmpty():
            return found, kinds
        width += 1


def _hashed(ends: DataFrame) -> DataFrame:
    """(node, hash): lower-case SHA-256 of the ids of ``ends`` (node, conv_id), ascending and joined by commas. Ranges join
    their ids to pieces first; a digest then takes in pieces in their order, never a whole list."""
    ranged = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, PIECE):
                node, conv = b.column(0).slice(i, PIECE).dictionary_encode(), b.column(1).slice(i, PIECE).to_numpy()
                k = node.indices.to_numpy(zero_copy_only=False)
                first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                text = [",".join(map(str, x.tolist())).encode() for x in np.split(conv, first[1:])]
                yield pa.RecordBatch.from_arrays([node.dictionary.take(pa.array(k[first])), pa.array(conv[first]), pa.array(text, pa.binary())], ["node", "conv_id", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            names, out = [], []
            for node, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node == last:
                    state.update(b",")
                else:
                    if state:
                        names.append(last)
                        out.append(state.hexdigest())
                    last, state = node, hashlib.sha256()
                state.update(ids)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string())], ["node", "hash"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([state.hexdigest()])], ["node", "hash"])

    dealt = ranged.mapInArrow(pieces, "node string, conv_id long, ids binary").repartition("node").sortWithinPartitions("node", "conv_id")
    return dealt.select("node", "ids").mapInArrow(digest, "node string, hash string")


def _name(depth: Column, fp: Column) -> Column:
    return F.concat_ws(":", depth.cast("string"), F.array_join(fp.cast("array<string>"), ":"))


def conversation_trie(rebuilt_turns: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, (n_convs - 1) times the bytes of a node's
    last text) and ends_sha256 (of the ids of members that end there).

    ``rebuilt_turns``: conv_id, depth from 1, role, text; a row of depth 0 stands for a conversation without turns. An
    empty table has no node. Roles and texts are compared whole; very long ones travel once more than short ones."""
    rebuilt_turns = stored(rebuilt_turns.select("conv_id", "depth", "role", "text"), "rebuilt")
    turns = rebuilt_turns.filter("depth > 0")
    found, kinds = _verified(turns, primes)
    convs = stored(rebuilt_turns.groupBy("conv_id").agg(F.max("depth").alias("length")), "conversations")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    child = kinds.groupBy(F.col("parent").alias("fp"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = kinds.join(child, ["depth", "fp"], "left")
    nodes = stored(nodes.select(_name(F.col("depth"), F.col("fp")).alias("node"), F.when(F.col("depth") > 1, _name(F.col("depth") - 1, F.col("parent"))).otherwise("0").alias("parent"), "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children")), "nodes")
    # the first depth at which a conversation is the smallest member, and whether its last node is childless
    own = nodes.groupBy("conv_id").agg(F.min("depth").alias("from"), F.max(F.when(F.col("n_children") == 0, 1)).alias("leaf"))
    about = convs.join(own, "conv_id", "left").select("conv_id", "length", F.coalesce("from", F.col("length") + 1).alias("from"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    shared = found.join(about, "conv_id").filter(F.col("depth") == F.col("from") - 1).select("conv_id", F.col("bytes").alias("shared"))
    about = stored(about.join(shared, "conv_id", "left").withColumn("shared", F.coalesce("shared", F.lit(0))), "owned")
    before = found.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("bytes").alias("before"))
    rows = found.join(before, ["conv_id", "depth"], "left").join(about, "conv_id")
    saved = F.when(F.col("depth") < F.col("from"), F.col("shared") - F.coalesce("before", F.lit(0))).otherwise(0)
    sums = rows.groupBy(_name(F.col("depth"), F.col("fp")).alias("node")).agg(F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    ends = rows.filter("depth = length").select(_name(F.col("depth"), F.col("fp")).alias("node"), "conv_id")
    ends = ends.unionByName(about.filter("length = 0").select(F.lit("0").alias("node"), "conv_id"))
    top = about.agg(F.sum("leaf").alias("n_leaves"), F.sum("shared").alias("saved_tokens"))
    children = nodes.filter("depth = 1").agg(F.count(F.lit(1)).alias("n_children"))
    root = root.join(F.broadcast(top)).join(F.broadcast(children))  # a row each
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))
    root = root.select(F.lit("0").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", "n_children", leaves.alias("n_leaves"), "saved_tokens")
    every = stored(nodes.join(sums, "node").select(root.columns).unionByName(root), "summed")
    parents = every.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    out = hot_join(every, parents, "parent", "n").join(_hashed(ends), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("hash", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
