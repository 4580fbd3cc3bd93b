"""Language-model scores by a hierarchical Pitman-Yor model.

Each previous word is a context with a restaurant of its own; all contexts share one parent, the restaurant of single
words, over a uniform base on the known words and one unknown. Each training token is a customer; tables in a context's
restaurant are customers of the parent. Predictive probabilities are averaged over the last sweeps.

Gibbs sampling of seatings. Probabilities depend on a seating only through the number of tables of each pair (context,
word). With a discount of a half, the number of ways to seat c customers at t tables has the closed form
S(c, t) = (2c - t - 1)! / ((t - 1)! (c - t)! 4^(c - t)), and with an auxiliary gamma variable x for each restaurant the
pairs in it are independent: P(t) is proportional to S(c, t) (x p / 2)^t, p the word's probability in the parent. So a
sweep draws x from all tables of a restaurant and then every pair's tables from that exact conditional, however many
customers a pair has (``draw_tables``). The parent's tables are drawn in the same way. Contexts are seated against the
parent of the last exchange.

How it is spread: documents are read once into blocks of distinct pairs, dealt over shards of about SHARD_TOKENS tokens by
the context's hash, so that a restaurant is in one shard. Words of a shard and buckets of words exchange customers, tables
and counts in arrays by shuffles: nothing that grows with the corpus passes the driver or one task. Contexts that fill
more than half a shard (at most twice as many as there are shards) are dealt by word as well, and only their totals pass
the driver. Each step is a table in the shared folder; random numbers depend on shard and sweep alone.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Stored, get, put, runs
from .langid import held_out

SHARD_TOKENS = 2_000_000
BLOCK_BYTES = 8 << 20
#: Documents whose words are counted to choose short codes and to find contexts that fill a shard; both only change how
#: the work is coded and dealt.
SAMPLED, CODES = 20_000, 0xFFFF
DISCOUNT = 0.5
#: Strengths of the contexts' restaurants and of their parent.
THETA, THETA_ROOT = 1.0, 1.0
#: Sweeps of all restaurants with an exchange after each, and sweeps after these whose probabilities are averaged.
BURN_IN, AVERAGED = 2, 3
_END, _START = 0x9D5A3C7B1E2F4A69, 0x51C3A9D27F0B6E85
_POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(4095, 0x100000001B3, np.uint64))))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Rows of every step: ``kind`` says what ``x`` holds, ``to`` is the group (shard, bucket of words or block) it goes to.
ROW = "to long, kind int, frm long, x array<binary>"
DOC, ASK, SHARD, ACTIVE, WORDS, HOT_COUNT, HOT_TABLES, INDEX, REPLY, COUNTS, SUM, STATE, MESSAGE, ANSWER = range(14)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in ``data``, ASCII letters as lower case, and where in it each starts."""
    b = np.frombuffer(data.lower(), np.uint8)
    inside = ~_SPACE[b]
    if not inside.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    kept = np.flatnonzero(inside)
    at = np.flatnonzero(first[kept])  # where words start among the kept bytes
    place = np.arange(len(kept)) - np.repeat(at, np.diff(np.append(at, len(kept))))
    power = _POWERS[place & 4095]
    if len(kept) and place.max() > 4095:
        power = power * (np.uint64(0xD6E8FEB86659FD93) * (place >> 12).astype(np.uint64) + np.uint64(1))
    h = np.add.reduceat((b[kept].astype(np.uint64) + np.uint64(1)) * power, at)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33)), starts


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hash and index of the text for each token; every text ends with an end token."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
    h, starts = word_hashes(b"\n".join(raw))
    doc = np.searchsorted(begin, starts, side="right") - 1
    n = np.bincount(doc, minlength=len(raw))
    out = np.empty(len(h) + len(raw), np.uint64)
    out[np.arange(len(h)) + doc] = h
    out[np.cumsum(n + 1) - 1] = _END
    return out, np.repeat(np.arange(len(raw)), n + 1)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Ascends with the hash."""
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["to", "kind", "frm", "x"])


def _grouped(df: DataFrame, work: Callable[[int, dict[int, list[tuple[int, list[bytes]]]]], list[tuple]]) -> DataFrame:
    """``work`` on the rows of each group, by kind and in the order of ``frm``."""

    def run(t: pa.Table) -> pa.Table:
        rows: dict[int, list] = {}
        for kind, frm, x in sorted(zip(t["kind"].to_pylist(), t["frm"].to_pylist(), t["x"].to_pylist(), strict=True), key=lambda r: r[:2]):
            rows.setdefault(kind, []).append((frm, x))
        return pa.Table.from_batches([_batch(work(t["to"][0].as_py(), rows))])

    return df.groupBy("to").applyInArrow(run, ROW)


def draw_tables(count: np.ndarray, z: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each number of customers (1 or more), a number of tables t with P(t) proportional to S(count, t) z^t. P falls
    from its mode with a variance below the mode, so t is drawn by inversion from all values within ten deviations and 30
    of it, outside which less than a double can tell is left."""
    out = np.ones(len(count), np.int64)
    many = np.flatnonzero(count > 1)
    for i in range(0, len(many), 1 << 14):
        m = many[i : i + (1 << 14)]
        c, y = count[m].astype(np.float64), z[m]
        b = 2 * c - 1 + 4 * y
        mode = 8 * y * c / (b + np.sqrt(np.maximum(b * b - 16 * y * c, 0)))
        half = 10 * np.sqrt(mode) + 30
        low, high = np.maximum(1, np.floor(mode - half)), np.minimum(c, np.ceil(mode + half))
        low = np.minimum(low, high)
        n = (high - low + 1).astype(np.int64)
        first = np.cumsum(n) - n
        t = np.arange(n.sum()) - np.repeat(first - low.astype(np.int64), n)
        c, y = np.repeat(c, n), np.repeat(y, n)
        up = np.zeros(len(t))  # log of P(t) / P(t - 1)
        rest = np.ones(len(t), bool)
        rest[first] = False
        up[rest] = np.log(4 * y[rest] * (c[rest] - t[rest] + 1) / ((t[rest] - 1) * (2 * c[rest] - t[rest])))
        s = np.cumsum(up)
        s -= np.repeat(np.maximum.reduceat(s, first), n)
        cum = np.cumsum(np.exp(s))
        before = np.concatenate(([0.0], cum))[first]
        u = before + rng.random(len(m)) * (cum[first + n - 1] - before)
        out[m] = t[np.clip(np.searchsorted(cum, u, side="right"), first, first + n - 1)]
    return out


def sweep(count: np.ndarray, context: np.ndarray, tables: np.ndarray, parent: np.ndarray, total: np.ndarray, rng: np.random.Generator, x: np.ndarray | None = None, theta: float = THETA) -> np.ndarray:
    """Tables drawn anew for pairs with ``count`` customers in ``context``. ``total``: present tables by context, of all its
    pairs; ``x``: the auxiliary variable of contexts where it is not NaN, drawn here for the others."""
    own = rng.standard_gamma(theta / DISCOUNT + total)
    own = own if x is None else np.where(np.isnan(x), own, x)
    return draw_tables(count, DISCOUNT * parent * own[context], rng)


def parent_probability(customers: np.ndarray, tables: np.ndarray, sums: dict[str, int]) -> np.ndarray:
    """Of words with so many customers and tables in the parent, whose totals are ``sums``; 0 customers: each word but seen
    ones has it, the unknown word too."""
    base = 1 / (sums["v"] + 1)
    return (customers - DISCOUNT * tables + (THETA_ROOT + DISCOUNT * sums["t"]) * base) / (THETA_ROOT + sums["k"])


def pair_probability(count: np.ndarray, tables: np.ndarray, customers: np.ndarray, all_tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """``customers``, ``all_tables``: of each pair's context."""
    return (count - DISCOUNT * tables + (THETA + DISCOUNT * all_tables) * parent) / (customers + THETA)


def _blocks(shards: int, codes: np.ndarray, hot: np.ndarray):
    """mapInArrow over (id as text, text, held out): a DOC row and ASK rows for each block of texts."""

    def block(key: int, texts: list, ids: list, out: list) -> list[tuple]:
        h, doc = tokens(texts)
        vocab, rank = np.unique(np.append(h, np.uint64(_START)), return_inverse=True)
        before = np.empty(len(h), np.int64)
        before[1:] = rank[:-2]
        before[np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))] = rank[-1]
        v = len(vocab)
        pair, token = np.unique(before * v + rank[:-1], return_inverse=True)
        train = ~np.array(out, bool)
        n = np.bincount(token, weights=train[doc], minlength=len(pair)).astype(np.int64)
        u, w = pair // v, pair % v
        p = shard_of(vocab, shards)[u]
        split = np.isin(vocab, hot)[u]
        p[split] = (p[split] + (vocab[w[split]] % np.uint64(shards)).astype(np.int64)) % shards
        order = np.argsort(p, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        p, u, w, n = p[order], u[order], w[order], n[order]
        lengths = np.bincount(doc, minlength=len(texts))
        entry = np.sort((doc.astype(np.int64) << 32) | place[token]) & 0xFFFFFFFF
        step = entry.copy()  # from the entry before; from 0 at the first of each text
        step[1:] -= entry[:-1]
        step[np.cumsum(lengths) - lengths] = entry[np.cumsum(lengths) - lengths]
        rows = [(key, DOC, 0, [json.dumps(ids).encode(), put(lengths, np.uint32), np.array(out, bool).tobytes(), put(step, np.uint32)])]
        code = np.full(v, CODES, np.uint16)
        if len(codes):
            at = np.minimum(np.searchsorted(codes, vocab), len(codes) - 1)
            code = np.where(codes[at] == vocab, at, CODES).astype(np.uint16)
        for to, a, b in runs(p):
            own_runs = list(runs(u[a:b]))
            own = code[w[a:b]]
            rows.append((to, ASK, key, [
                put(vocab[[x for x, _, _ in own_runs]], np.uint64), put(np.array([e - s for _, s, e in own_runs]), np.uint32), put(own, np.uint16), put(vocab[w[a:b][own == CODES]], np.uint64), put(n[a:b], np.uint32)]))
        return rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        texts, ids, out, size = [], [], [], 0
        for b in batches:
            for i, t, o in zip(*(c.to_pylist() for c in b.columns), strict=True):
                texts.append(t)
                ids.append(i)
                out.append(o)
                size += len(t or "") + 64
                if size >= BLOCK_BYTES:
                    yield _batch(block(key, texts, ids, out))
                    key, texts, ids, out, size = key + 1, [], [], [], 0
        if texts:
            yield _batch(block(key, texts, ids, out))

    return work


def _merge(shards: int, codes: np.ndarray, hot: np.ndarray):
    """The blocks of a shard: pairs by context and word, and which pair each of a block's entries is."""

    def work(p: int, rows: dict[int, list]) -> list[tuple]:
        asks = rows[ASK]
        decode = lambda k, kind: np.concatenate([get(x[k], kind) for _, x in asks])
        u = np.repeat(decode(0, np.uint64), decode(1, np.uint32).astype(np.int64))
        code, n = decode(2, np.uint16), decode(4, np.uint32).astype(np.int64)
        w = np.append(codes, np.uint64(0))[np.minimum(code, len(codes))]
        w[code == CODES] = decode(3, np.uint64)
        ctx, u = np.unique(u, return_inverse=True)
        words, w = np.unique(w, return_inverse=True)
        pair, entry = np.unique(u * len(words) + w, return_inverse=True)
        u, w = pair // len(words), pair % len(words)
        c = np.bincount(entry, weights=n, minlength=len(pair)).astype(np.int64)
        known = c > 0
        active = np.flatnonzero(c > 1)
        base = np.bincount(u[known], minlength=len(ctx))  # tables, if each pair has one
        is_hot = np.searchsorted(hot, ctx[np.isin(ctx, hot)])
        hot_at = np.flatnonzero(np.isin(ctx, hot))
        customers = np.bincount(u, weights=c, minlength=len(ctx)).astype(np.int64)
        sizes = np.array([len(x[2]) // 2 for _, x in asks])
        out = [
            (p, SHARD, 0, [put(ctx, np.uint64), put(np.bincount(u, minlength=len(ctx)), np.uint32), put(w, np.uint32), put(c, np.uint32), put(words, np.uint64), put(np.array([k for k, _ in asks]), np.int64), put(sizes, np.uint32), put(entry, np.uint32)]),
            (p, ACTIVE, 0, [put(u[active], np.uint32), put(w[active], np.uint32), put(c[active], np.uint32), put(base, np.uint32), put(hot_at, np.uint32), put(is_hot, np.uint32), put(np.array([len(words)]), np.uint32)]),
        ]
        k0, cw = np.bincount(w[known], minlength=len(words)), np.bincount(w, weights=c, minlength=len(words))
        for b, s, e in runs(shard_of(words, shards)):
            out.append((b, WORDS, p, [put(words[s:e], np.uint64), put(k0[s:e], np.uint32), put(cw[s:e], np.uint64)]))
        for at, which in zip(hot_at.tolist(), is_hot.tolist(), strict=True):
            out += [(which, HOT_COUNT, int(customers[at]), None), (which, HOT_TABLES, int(base[at]), None)]
        return out

    return work


def _index(b: int, rows: dict[int, list]) -> list[tuple]:
    """A bucket of words: customers in the parent if each pair has one table, tokens, and which words each shard has."""
    got = rows[WORDS]
    sizes = [len(x[0]) // 8 for _, x in got]
    words, at = np.unique(np.concatenate([get(x[0], np.uint64) for _, x in got]), return_inverse=True)
    total = lambda k, kind: np.bincount(at, weights=np.concatenate([get(x[k], kind) for _, x in got]), minlength=len(words)).astype(np.int64)
    k, c = total(1, np.uint32), total(2, np.uint64)
    own = np.split(at, np.cumsum(sizes)[:-1])
    out = [(b, INDEX, 0, [put(k, np.uint32), put(np.array([p for p, _ in got]), np.int64), put(np.array(sizes), np.uint32), put(at, np.uint32)])]
    for (p, _), i in zip(got, own, strict=True):
        out += [(p, REPLY, b, [put(k[i], np.uint32), put(np.minimum(k, 1)[i], np.uint32)]), (p, COUNTS, b, [put(c[i], np.uint64)])]
    return out + [(i, SUM, int(s), None) for i, s in enumerate((c.sum(), (c > 0).sum(), k.sum(), (k > 0).sum()))]


def _root(round_: int, sums: dict[str, int], x: float):
    """The parent's customers after a sweep of the contexts, and its tables drawn anew."""

    def work(b: int, rows: dict[int, list]) -> list[tuple]:
        ((_, stat),) = rows[INDEX]
        k = get(stat[0], np.uint32).astype(np.int64)
        parts, at = get(stat[1], np.int64).tolist(), np.split(get(stat[3], np.uint32).astype(np.int64), np.cumsum(get(stat[2], np.uint32).astype(np.int64))[:-1])
        sent = dict(rows.get(MESSAGE, []))
        for p, i in zip(parts, at, strict=True):
            if p in sent:
                k[i] += get(sent[p][0], np.uint32).astype(np.int64)
        t = np.minimum(k, 1)
        some = np.flatnonzero(k)
        t[some] = draw_tables(k[some], np.full(len(some), DISCOUNT * x / (sums["v"] + 1)), np.random.default_rng((b, round_, 1)))
        return [(p, REPLY, b, [put(k[i], np.uint32), put(t[i], np.uint32)]) for p, i in zip(parts, at, strict=True)] + [(2, SUM, int(k.sum()), None), (3, SUM, int(t.sum()), None)]

    return work


def _parent(rows: list, sums: dict[str, int]) -> np.ndarray:
    """Probabilities of a shard's words, from the replies of the buckets in order."""
    k, t = (np.concatenate([get(x[i], np.uint32) for _, x in rows]).astype(np.float64) for i in (0, 1))
    return parent_probability(k, t, sums)


def _seat(round_: int, sweeps: int, sums: dict[str, int], shards: int, hot_tables: np.ndarray, hot_x: np.ndarray):
    """Sweeps over the pairs of a shard that have two customers or more; of others the one table is certain. STATE holds
    the tables beyond the first of each such pair, summed over the sweeps."""

    def work(p: int, rows: dict[int, list]) -> list[tuple]:
        ((_, a),) = rows[ACTIVE]
        u, w, c, base, hot_at, is_hot = (get(x, np.uint32).astype(np.int64) for x in a[:6])
        parent = _parent(rows[REPLY], sums)
        extra = get(rows[STATE][0][1][0], np.uint32).astype(np.int64) if STATE in rows else np.zeros(len(u), np.int64)
        rng = np.random.default_rng((p, round_, 0))
        own = lambda e: base + np.bincount(u, weights=e, minlength=len(base)).astype(np.int64)
        others = np.zeros(len(base), np.int64)  # tables of hot contexts in other shards
        others[hot_at] = hot_tables[is_hot] - own(extra)[hot_at]
        summed = np.zeros(len(u), np.int64)
        for k in range(sweeps):
            x = np.full(len(base), np.nan)
            x[hot_at] = hot_x[k][is_hot]
            extra = sweep(c, u, 1 + extra, parent[w], np.maximum(own(extra) + others, 1), rng, x) - 1
            summed += extra
        added = np.bincount(w, weights=summed, minlength=len(parent)).astype(np.int64)
        out, at = [(p, STATE, 0, [put(summed, np.uint32)])], 0
        for b, x in rows[REPLY]:
            n = len(x[0]) // 4
            out.append((b, MESSAGE, p, [put(added[at : at + n], np.uint32)]))
            at += n
        tables = sweeps * base + np.bincount(u, weights=summed, minlength=len(base)).astype(np.int64)
        return out + [(which, HOT_TABLES, int(tables[at]), None) for at, which in zip(hot_at.tolist(), is_hot.tolist(), strict=True)]

    return work


def shard_model(rows: dict[int, list], sums: dict[str, int], hot: np.ndarray, hot_count: np.ndarray, hot_tables: np.ndarray) -> dict[str, np.ndarray]:
    """Of a shard, after all sweeps: ``context``, ``word`` (hashes), ``count``, ``probability`` and ``parent`` by pair, and
    ``left`` by pair, the part of its context's probability that goes to the parent."""
    s = rows[SHARD][0][1]
    ctx, words = get(s[0], np.uint64), get(s[4], np.uint64)
    u, w, c = np.repeat(np.arange(len(ctx)), get(s[1], np.uint32).astype(np.int64)), get(s[2], np.uint32).astype(np.int64), get(s[3], np.uint32).astype(np.float64)
    tables = np.minimum(c, 1)
    active = np.flatnonzero(c > 1)
    tables[active] += get(rows[STATE][0][1][0], np.uint32) / AVERAGED
    customers, all_tables = np.bincount(u, weights=c, minlength=len(ctx)), np.bincount(u, weights=tables, minlength=len(ctx))
    at = np.flatnonzero(np.isin(ctx, hot))
    which = np.searchsorted(hot, ctx[at])
    customers[at], all_tables[at] = hot_count[which], hot_tables[which] / AVERAGED
    parent = _parent(rows[REPLY], sums)[w]
    left = (THETA + DISCOUNT * all_tables[u]) / (customers[u] + THETA)
    return {"context": ctx[u], "word": words[w], "word_at": w, "count": c, "parent": parent, "left": left, "probability": pair_probability(c, tables, customers[u], all_tables[u], parent)}


def _answer(sums: dict[str, int], hot: np.ndarray, hot_count: np.ndarray, hot_tables: np.ndarray):
    """For each block, the log probability and the training tokens of the word for each of its entries here."""

    def work(p: int, rows: dict[int, list]) -> list[tuple]:
        m = shard_model(rows, sums, hot, hot_count, hot_tables)
        s = rows[SHARD][0][1]
        counts = np.concatenate([get(x[0], np.uint64) for _, x in rows[COUNTS]])[m["word_at"]]
        score = np.log10(m["probability"]).astype(np.float32)
        entry, out, at = get(s[7], np.uint32).astype(np.int64), [], 0
        for block, n in zip(get(s[5], np.int64).tolist(), get(s[6], np.uint32).tolist(), strict=True):
            own = entry[at : at + n]
            out.append((block, ANSWER, p, [put(score[own], np.float32), put(counts[own], np.uint64)]))
            at += n
        return out

    return work


def _documents(t: pa.Table) -> pa.Table:
    rows: dict[int, list] = {}
    for kind, frm, x in sorted(zip(t["kind"].to_pylist(), t["frm"].to_pylist(), t["x"].to_pylist(), strict=True), key=lambda r: r[:2]):
        rows.setdefault(kind, []).append(x)
    ids, lengths, out, step = rows[DOC][0]
    lengths, step = get(lengths, np.uint32).astype(np.int64), get(step, np.uint32).astype(np.int64)
    first = np.cumsum(lengths) - lengths  # every text has an end
    entry = np.cumsum(step)
    entry -= np.repeat(entry[first] - step[first], lengths)
    score, count = (np.concatenate([get(x[i], kind) for x in rows[ANSWER]]).astype(np.float64) for i, kind in ((0, np.float32), (1, np.uint64)))
    total = lambda v: np.add.reduceat(v[entry], first)
    cols = {"id": pa.array(json.loads(ids), pa.string()), "held_out": pa.array(np.frombuffer(out, bool)), "n_tokens": pa.array(lengths), "n_known": pa.array(total((count > 0).astype(np.int64)))}
    return pa.table(cols | {"b": pa.array(total(np.log10(count + 1))), "score": pa.array(total(score))})


def common_words(docs: DataFrame, rows: int) -> tuple[list[tuple[str, int]], int]:
    """The CODES most frequent words in about SAMPLED documents, and the number of all words there."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    some = docs.filter(F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(max(1, rows // SAMPLED))) == 0)
    words = some.select(F.explode(F.regexp_extract_all(F.translate("text", letters, letters.lower()), F.lit(WORD), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = words.orderBy(F.desc("n"), "w").limit(CODES).toPandas()
    return list(zip(found["w"], found["n"].tolist(), strict=True)), int(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) + some.count()


def _sums(step: DataFrame, kind: int, n: int) -> np.ndarray:
    """Totals of ``frm`` by ``to``, n rows at most."""
    out = np.zeros(n, np.int64)
    for r in step.filter(F.col("kind") == kind).groupBy("to").agg(F.sum("frm").alias("s")).collect():
        out[r["to"]] = r["s"]
    return out


def trained(docs: DataFrame, id_col: str, text_col: str, folds: int, fold: int) -> tuple[Stored, DataFrame | None, dict]:
    """The steps up to the last sweep: the stored tables, the rows by shard that ``shard_model`` takes, and its other arguments."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col), folds, fold).alias("out"))
    length, n_rows = base.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    steps = Stored(spark, "hpylm")
    if not n_rows:
        return steps, None, {}
    shards = max(1, math.ceil(((length or 0) / 6 + n_rows) / SHARD_TOKENS))
    top, seen = common_words(base, n_rows)
    hash_of = lambda ws: np.concatenate([np.empty(0, np.uint64), word_hashes(b"\n".join(w.encode("utf-8", "surrogatepass") for w in ws))[0]])
    codes = np.unique(hash_of([w for w, _ in top]))
    hot = np.unique(hash_of([w for w, n in top if 2 * n * shards > seen])) if shards > 1 else np.empty(0, np.uint64)
    if shards > 1 and 2 * n_rows * shards > (length or 0) / 6 + n_rows:
        hot = np.unique(np.append(hot, np.uint64(_START)))
    blocks = steps.put("blocks", base.mapInArrow(_blocks(shards, codes, hot), ROW), by="kind")
    merged = steps.put("shards", _grouped(blocks.filter(F.col("kind") == ASK), _merge(shards, codes, hot)), by="kind")
    steps.drop("blocks", kind=ASK)
    hot_count, hot_tables = (_sums(merged, kind, len(hot)) for kind in (HOT_COUNT, HOT_TABLES))
    index = steps.put("index", _grouped(merged.filter(F.col("kind") == WORDS), _index), by="kind")
    steps.drop("shards", kind=WORDS)
    sums = dict(zip(("n", "v", "k", "t"), _sums(index, SUM, 4).tolist(), strict=True))
    active, stat, state, reply = (d.filter(F.col("kind") == k) for d, k in ((merged, ACTIVE), (index, INDEX), (merged, STATE), (index, REPLY)))
    rng = np.random.default_rng(7)
    for k in range(BURN_IN + 1):
        last = k == BURN_IN
        hot_x = rng.standard_gamma(THETA / DISCOUNT + hot_tables, (AVERAGED if last else 1, len(hot)))
        seats = steps.put(f"seats{k}", _grouped(active.unionByName(state).unionByName(reply), _seat(k, AVERAGED if last else 1, sums, shards, hot_tables, hot_x)), by="kind")
        hot_tables = _sums(seats, HOT_TABLES, len(hot))
        state = seats.filter(F.col("kind") == STATE)
        if not last:
            root = _root(k, sums, float(rng.standard_gamma(THETA_ROOT / DISCOUNT + sums["t"])))
            parent = steps.put(f"parent{k}", _grouped(stat.unionByName(seats.filter(F.col("kind") == MESSAGE)), root), by="kind")
            _, _, sums["k"], sums["t"] = _sums(parent, SUM, 4).tolist()
            reply = parent.filter(F.col("kind") == REPLY)
    rows = merged.filter(F.col("kind") == SHARD).unionByName(state).unionByName(reply).unionByName(index.filter(F.col("kind") == COUNTS))
    return steps, rows, {"sums": dict(sums), "hot": hot, "hot_count": hot_count, "hot_tables": hot_tables}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score (the
    model's log10 probability of the text) and perplexity (10 to the power of -score / n_tokens). The model learns from
    rows not held out; the probabilities of a context's words and of one unknown word sum to one.

    A null text is empty: its one token is the end. A row without an id is not held out. Ids may be of any type with a
    text form. Repeated rows are scored one by one and learnt from as often. An empty table gives an empty result. Other
    columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    steps, rows, model = trained(docs, id_col, text_col, folds, fold)
    schema = "id string, held_out boolean, n_tokens long, n_known long, b double, score double"
    if rows is None:
        found, n, v = docs.sparkSession.createDataFrame([], schema), 0, 0
    else:
        answers = steps.put("answers", _grouped(rows, _answer(**model)))
        steps.drop("shards")
        texts = docs.sparkSession.read.schema(ROW).parquet(steps.path("blocks")).filter(F.col("kind") == DOC)
        found, n, v = texts.unionByName(answers).groupBy("to").applyInArrow(_documents, schema), model["sums"]["n"], model["sums"]["v"]
    return found.select(
        F.col("id").cast(kind).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("b") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
