"""Phrase collocations by suffix sorting.

A text is cut into pieces at punctuation and line ends, and pieces into words. Every word begins a suffix of up to SIZE
words of its piece. Suffixes are shuffled by language and first word, sorted reverse-lexicographically, and all their
prefixes are counted in one pass with a stack that has a place for each length; the counts are joined with those of
their parts afterwards.

1. Words, and pairs of neighbouring words, of a language are counted by hash, in SLOTS and PAIRS numbers at any size of the
   corpus. A slot is never below the count of what falls in it. So a word or pair whose slot is below ``least`` can be in
   no phrase, and pieces are cut there too; where slots are full, less is cut, and the result is the same.
2. Suffixes of a block of texts are sorted and counted before they are shuffled, and travel as arrays: their words once,
   then numbers. A first word with more than SLICE occurrences is dealt by its second and third words as well; what is
   counted of its prefixes of one and two words is then a part, and the parts are summed.
3. Phrases with their counts are joined with their parts' counts. Numbers are exact: decimals of 38 digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import blocks, coded, running, text_bytes, words
from .common import get, put, runs, stored

#: Words of a phrase at most; occurrences of a phrase at least; phrases that are listed for each language.
SIZE, LEAST, LISTED = 5, 100, 2000
NO_LANGUAGE = "und"
#: Numbers that hashed words and pairs of words are counted in first, and how many of them in one row.
SLOTS, PAIRS, PART = 1 << 20, 1 << 23, 1 << 16
#: Occurrences of a first word in one bucket at most, about, and words of a bucket on average.
SLICE, BUCKET = 1 << 20, 1 << 21
_BREAK = b".,;:!?\n\x0b\x0c\r"
_INSIDE = np.array([c not in _BREAK + b" \t" for c in range(256)])
_BREAKS = np.array([c in _BREAK for c in range(256)])
_BITS = 21  # of a word's number in a sort key


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hashes_of(lang: str, found: list[bytes]) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in found), np.uint64, len(found))


class Block:
    """Words of some texts: ``word`` (number), ``lang`` (number) and ``far`` (no neighbour of the one before) of each; words and
    languages by number; ``hash`` of each (language, word) that occurs, which ``own`` tells of each word."""

    def __init__(self, text: pa.Array, lang: pa.Array) -> None:
        data, offsets = text_bytes(text)
        found, starts, of = words(data, offsets, _INSIDE, lower=True)
        self.word, self.words = coded(found)
        d = pa.compute.fill_null(lang, NO_LANGUAGE).dictionary_encode()
        self.langs = d.dictionary.to_pylist()
        self.lang = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)[of]
        piece = running(_BREAKS[data])[starts] + of
        self.far = np.concatenate(([True], piece[1:] != piece[:-1])) if len(piece) else np.empty(0, bool)
        both, self.own = np.unique(self.lang * max(1, len(self.words)) + self.word, return_inverse=True)
        self.hash = np.empty(len(both), np.uint64)
        for k, a, b in runs(both // max(1, len(self.words))):
            self.hash[a:b] = hashes_of(self.langs[k], [self.words[i] for i in both[a:b] % len(self.words)])

    def slots(self) -> np.ndarray:
        """Of each (language, word)."""
        return (self.hash & np.uint64(SLOTS - 1)).astype(np.int32)

    def pair_slots(self) -> np.ndarray:
        """Of each word and the one before it; -1 where that is far."""
        h = self.hash[self.own]
        out = np.full(len(h), -1, np.int32)
        out[1:] = (_mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) & np.uint64(PAIRS - 1)).astype(np.int32)
        out[self.far] = -1
        return out


def slot_counts(docs: DataFrame, text_col: str, lang_col: str) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Occurrences of each slot's words (SLOTS numbers); (part, counts) with those of each slot's pairs, PART in a row; and
    (lang, n): words of each language."""
    tables = ((0, SLOTS), (SLOTS // PART, PAIRS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [np.zeros(m, np.uint32) for _, m in tables], {}
        for b in blocks(batches, 0):
            x = Block(b.column(0), b.column(1))
            pairs = x.pair_slots()
            for t, at in zip(total, (x.slots()[x.own], pairs[pairs >= 0]), strict=True):
                slot, times = np.unique(at, return_counts=True)
                t[slot] += times.astype(np.uint32)
            for k, m in enumerate(np.bincount(x.lang, minlength=len(x.langs)).tolist()):
                n[x.langs[k]] = n.get(x.langs[k], 0) + m
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
        row = lambda *c: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(c, kinds, strict=True)], ["lang", "part", "n", "counts"])
        for (first, m), t in zip(tables, total, strict=True):
            yield from (row(None, first + i // PART, 0, put(t[i : i + PART], np.uint32)) for i in range(0, m, PART) if t[i : i + PART].any())
        yield from (row(k, -1, m, None) for k, m in n.items())

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([put(total, np.int64)], pa.binary())], ["part", "counts"])
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = get(x.as_buffer().to_pybytes(), np.uint32)
                if k != part:
                    if part is not None:
                        yield row()
                    part, total = k, np.zeros(PART, np.int64)
                total += own
        if part is not None:
            yield row()

    seen = stored(docs.select(text_col, lang_col).mapInArrow(count, "lang string, part int, n long, counts binary"), "words")
    dealt = seen.filter("part >= 0").select("part", "counts").repartition("part").sortWithinPartitions("part")
    summed = stored(dealt.mapInArrow(added, "part int, counts binary"), "slots")
    out = np.zeros(SLOTS, np.int64)
    for r in summed.filter(F.col("part") < SLOTS // PART).collect():  # SLOTS numbers
        out[r["part"] * PART : (r["part"] + 1) * PART] = get(bytes(r["counts"]), np.int64)
    return out, summed.filter(F.col("part") >= SLOTS // PART).withColumn("part", F.col("part") - SLOTS // PART), seen.filter("part < 0").groupBy("lang").agg(F.sum("n").alias("n"))


def often(pairs: DataFrame, least: int) -> np.ndarray:
    """For each slot of pairs whether it is ``least`` or more: PAIRS bits."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.packbits(get(x, np.int64) >= least).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["part", "bits"])

    out = np.zeros(PAIRS // 8, np.uint8)
    for r in pairs.mapInArrow(bits, "part int, bits binary").collect():
        out[r["part"] * PART // 8 : (r["part"] + 1) * PART // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


_PACKED = "lang string, bucket long, words binary, ids binary, counts binary"


def packed_suffixes(docs: DataFrame, text_col: str, lang_col: str, slices: np.ndarray, paired: np.ndarray, buckets: int) -> DataFrame:
    """Distinct suffixes of blocks of texts with their counts, a row for each language and bucket. ``slices``: for each
    slot 0 if its words are rare, else over how many buckets one of its words is dealt. ``paired``: bits of ``often``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 0):
            x = Block(b.column(0), b.column(1))
            over, pair = slices[x.slots()][x.own], x.pair_slots()
            rare = x.far | ((paired[pair >> 3] >> (7 - (pair & 7)) & 1) == 0)
            run = np.cumsum(rare | (over == 0), dtype=np.int32)  # also cut before and behind rare words
            keep = over > 0
            word, lang, over, run = (x.word[keep] + 1).astype(np.int32), x.lang[keep], over[keep].astype(np.uint64), run[keep]
            cols = [word]
            for j in range(1, SIZE):
                cols.append(np.zeros(len(word), np.int32))
                cols[j][: max(0, len(word) - j)] = np.where(run[j:] == run[:-j], word[j:], 0)
            h = np.fromiter((xxhash.xxh64_intdigest(w) for w in [b"", *x.words]), np.uint64, len(x.words) + 1)
            tongue = np.fromiter((xxhash.xxh64_intdigest(k) for k in x.langs), np.uint64, len(x.langs))
            part = _mixed(h[cols[1]] + _mixed(h[cols[2]])) % np.maximum(over, np.uint64(1))
            bucket = (_mixed(h[word] ^ tongue[lang] ^ _mixed(part)) % np.uint64(buckets)).astype(np.int64)
            yield _rows(lang * buckets + bucket, cols, x, buckets)

    def _rows(group: np.ndarray, cols: list[np.ndarray], x: Block, buckets: int) -> pa.RecordBatch:
        order = np.lexsort((*cols[::-1], group))
        group, cols = group[order], [c[order] for c in cols]
        new = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.empty(0, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(group)))
        group, cols = group[first], np.stack([c[first] for c in cols]) if len(first) else np.empty((SIZE, 0), np.int32)
        out = []
        for k, a, b in runs(group):
            own, ids = np.unique(cols[:, a:b], return_inverse=True)
            if own[0]:
                own, ids = np.concatenate(([0], own)), ids + 1
            named = b" ".join(x.words[i - 1] for i in own[1:])
            out.append((x.langs[k // buckets], k % buckets, named, put(ids.reshape(SIZE, -1), np.uint32), put(n[a:b], np.uint32)))
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 5, kinds, strict=True)], [c.split()[0] for c in _PACKED.split(", ")])

    return docs.select(text_col, lang_col).mapInArrow(pack, _PACKED)


def count_prefixes(cols: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length the rows that open a prefix of so many words, and the prefix's count. ``cols``: SIZE x suffixes, in
    reverse-lexicographic order, 0 behind the last word.

    This is a stack with a place for each length: a suffix pops the places beyond the words that it shares with the one
    before and pushes its own words there. A place is open from one push to the next, so its count is the sum between."""
    if not len(counts):
        return
    push = np.zeros(len(counts), bool)
    push[0] = True
    for j in range(len(cols)):
        push[1:] |= cols[j, 1:] != cols[j, :-1]
        at = np.flatnonzero(push)
        n = np.add.reduceat(counts, at)
        given = cols[j, at] > 0
        yield j + 1, at[given], n[given]


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, slice_words: int = SLICE, bucket_words: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of all phrases of 1 to SIZE words that occur ``least`` times or more, and (lang, n)."""
    total, pairs, sizes = slot_counts(docs, text_col, lang_col)
    slices = np.where(total >= least, 1 + total // slice_words, 0).astype(np.int32)
    packed = packed_suffixes(docs, text_col, lang_col, slices, often(pairs, least), max(1, int(total.sum()) // bucket_words))

    def count(t: pa.Table) -> pa.Table:
        lang = t["lang"][0].as_py()
        named = [w.split(b" ") if w else [] for w in t["words"].to_pylist()]
        every = sorted(set().union(*named))
        rank = {w: i + 1 for i, w in enumerate(every)}
        parts = [np.array([0, *(rank[w] for w in ws)], np.int32)[get(i, np.uint32)].reshape(SIZE, -1) for ws, i in zip(named, t["ids"].to_pylist(), strict=True)]
        cols, n = np.concatenate(parts, axis=1), np.concatenate([get(c, np.uint32) for c in t["counts"].to_pylist()]).astype(np.int64)
        if len(every) < 1 << _BITS:
            wide = lambda a, b: (a.astype(np.int64) << _BITS) | b
            keys = (wide(cols[3], cols[4]), wide(wide(cols[0], cols[1]), cols[2]))
        else:
            keys = tuple(cols[::-1])
        order = np.lexsort(keys)[::-1]
        cols, n = cols[:, order], n[order]
        firsts = np.unique(cols[0])
        dealt = np.zeros(len(every) + 1, bool)
        dealt[firsts] = slices[(hashes_of(lang, [every[i - 1] for i in firsts]) & np.uint64(SLOTS - 1)).astype(np.int64)] > 1
        phrase, size, a, part = [], [], [], []
        for j, at, m in count_prefixes(cols, n):
            partial = dealt[cols[0, at]] & (j <= 2)
            keep = partial | (m >= least)
            at = at[keep]
            phrase += [b" ".join(every[k - 1] for k in row).decode() for row in cols[:j, at].T.tolist()]
            size.append(np.full(len(at), j))
            a.append(m[keep])
            part.append(partial[keep])
        cat = lambda x, kind: np.concatenate([np.empty(0, kind), *x]).astype(kind)
        return pa.table({"lang": pa.array([lang] * len(phrase), pa.string()), "phrase": pa.array(phrase, pa.string()), "size": cat(size, np.int32), "a": cat(a, np.int64), "part": cat(part, bool)})

    found = stored(packed.groupBy("lang", "bucket").applyInArrow(count, "lang string, phrase string, size int, a long, part boolean"), "counted")
    summed = found.filter("part").groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return stored(found.filter("NOT part").select("lang", "phrase", "size", "a").unionByName(summed), "phrases"), sizes


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, listed: int = LISTED, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``listed`` phrases of each language.

    A null text is empty, a null language is ``und``; repeated rows count each time; other columns are not read; an empty
    table gives an empty result. Words are compared as bytes after A-Z are lower-cased. Of equal scores the greater count,
    then the phrase that is first by its bytes, comes first."""
    counts, totals = phrase_counts(docs, text_col, lang_col, least, **sizes)
    several = counts.filter("size > 1").select("lang", "phrase", "size", "a", F.split("phrase", " ").alias("w"))
    # a phrase inside a longer one that is as frequent is inside one that is longer by a word and as frequent
    inner = several.filter("size > 2").select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("size") - 1), " "))).alias("phrase")).distinct()
    kept = several.join(inner, ["lang", "phrase", "a"], "left_anti")
    cut = kept.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    scored = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    scored = scored.withColumn("_top", F.lit(1000).cast("decimal(4,0)") * _exact("a") * _exact("n")).withColumn("_low", _exact("l") * _exact("r"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("_top div _low").alias("score"), "k", "l", "r")).alias("x"), F.first("a").alias("a"), F.first("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # Spark ranks inside tasks first
    rows = worst.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score").withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= listed)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH t AS (SELECT COALESCE(lang, 'und') AS lang, unnest(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM t),
z AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
j AS (SELECT unnest(range(1, 6)) AS size),
s AS (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM p, j WHERE len(w) >= size),
f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS a FROM s GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
longer AS (SELECT lang, a, array_to_string(w[1:size - 1], ' ') AS phrase FROM c WHERE size > 2 UNION SELECT lang, a, array_to_string(w[2:size], ' ') FROM c WHERE size > 2),
kept AS (SELECT * FROM c WHERE NOT EXISTS (FROM longer WHERE longer.lang = c.lang AND longer.phrase = c.phrase AND longer.a = c.a)),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS left_, array_to_string(w[k + 1:size], ' ') AS right_ FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, n, CAST((1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
    FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = left_ JOIN f y ON y.lang = cut.lang AND y.phrase = right_ JOIN z ON z.lang = cut.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM worst QUALIFY rank <= 2000
"""
