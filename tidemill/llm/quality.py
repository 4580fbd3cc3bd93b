"""Quality rules learned from labels: gradient-boosted trees over document statistics.

Statistics of whole texts are counted by numpy on blocks of texts. Trees are fitted on at most FIT_ROWS labelled
documents by second-order boosting of the logistic loss on histograms of BINS quantile bins. The prediction never rises
with the statistics in FALLING, all else being equal: a split on one of them is taken only if its right side's value is
not the greater, and both sides are held apart at the middle of their values all the way down. Trees are flattened into
arrays of nodes, and all rows walk down all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import blocks, coded, per_text, running, text_bytes, words
from .common import stored

#: Labelled documents that the trees are fitted on at most, about; statistics are of all documents.
FIT_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 40, 4, 0.25, 64
#: Penalty of a leaf's value, and least sum of second derivatives in a leaf.
PENALTY, LEAST_WEIGHT = 1.0, 0.5
#: Share of good documents of the rows left out of the fit that may fall below the threshold (one always may), and the
#: highest threshold.
LOST, MOST = 0.005, 0.5
#: Base rules: least words, and percent of words in repeated windows of so many words.
LEAST_WORDS, MOST_REPEATED, RUN = 10, 20, 5

BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeated", "upper", "digits", "shouts", "stops", "distinct", "longest", "line_words")
#: Statistics with which the quality never rises.
FALLING = ("symbols", "dup_lines", "repeated", "shouts")

_flags = lambda chars: np.isin(np.arange(256), list(chars))
_INSIDE = ~_flags(b" \t\n\x0b\x0c\r")
_SYMBOL, _UPPER, _LETTER = _flags(b"#*$%&|<>"), _flags(range(65, 91)), _flags([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGIT, _SHOUT, _STOP = _flags(b"0123456789"), _flags(b"!?"), _flags(b".,;:")
_CHARACTER = ~_flags(range(128, 192))  # the first byte of a character


def repeated_words(word: np.ndarray, of: np.ndarray, texts: int, size: int = RUN) -> np.ndarray:
    """Words of each text that are in a window of ``size`` words which the text has twice or more. Windows are numbered
    exactly, by pairs of numbers of shorter ones."""
    n = len(word) - size + 1
    if n < 1:
        return np.zeros(texts, np.int64)
    window, held = word, 1  # numbers of all runs of ``held`` words
    while held < size:
        step = min(held, size - held)
        a, b = window[:-step], window[step:]
        window = pd.factorize(a * (int(b.max()) + 1) + b)[0]
        held += step
    at = np.flatnonzero(of[:n] == of[size - 1 :])
    code, _ = pd.factorize(of[at] * (int(window.max()) + 1) + window[at])
    twice = at[(np.bincount(code) > 1)[code]] if len(code) else at
    edge = np.zeros(len(word) + 1, np.int64)
    edge[twice] += 1
    np.add.at(edge, twice + size, -1)
    return np.bincount(of[np.cumsum(edge)[:-1] > 0], minlength=texts)


def statistics(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n_words and BASE: 5 x texts; FEATURES: 12 x texts). A null text has no words; all its features are 0."""
    data, offsets = text_bytes(text)
    found, starts, of = words(data, offsets, _INSIDE)
    texts = len(offsets) - 1
    n = np.bincount(of, minlength=texts)
    count = lambda table: per_text(table[data], offsets)
    word, _ = coded(found)
    chars = count(_INSIDE & _CHARACTER)
    length = np.diff(np.append(running((_INSIDE & _CHARACTER)[data])[starts] - 1, chars.sum()))
    lines, twice = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    for i, t in enumerate(text):
        if n[i]:
            own = [x for x in t.as_buffer().to_pybytes().split(b"\n") if x.strip()]
            lines[i], twice[i] = len(own), len(own) - len(set(own))
    repeated = repeated_words(word, of, texts)
    different = np.bincount(of[np.unique(of * (len(word) + 1) + word, return_index=True)[1]], minlength=texts) if len(word) else n
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, of, length)
    symbols, letters = count(_SYMBOL), np.maximum(count(_LETTER), 1)
    w, c, k = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    features = (np.log1p(n), chars / w, symbols / c, twice / k, repeated / w, count(_UPPER) / letters, count(_DIGIT) / c, count(_SHOUT) / w, count(_STOP) / w, different / w, np.log1p(longest), n / k)
    return np.stack((n, chars, symbols, twice, repeated)).astype(np.int64), np.where(n > 0, np.stack(features), 0.0)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, BASE..., FEATURES...) of each row."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_words long, {', '.join(f'{c} long' for c in BASE)}, {', '.join(f'{c} double' for c in FEATURES)}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1):
            base, features = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, base), *map(pa.array, features)], ["id", "n_words", *BASE, *FEATURES])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(work, schema)


@dataclass
class Forest:
    """Flat trees: node k asks whether ``feature[k]`` is at most ``split[k]`` and goes to ``left[k]``, else to ``right[k]``;
    a leaf leads to itself and adds ``value[k]``. ``root``: first node of each tree."""

    bias: float = 0.0
    threshold: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    split: np.ndarray = field(default_factory=lambda: np.empty(0))
    left: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.empty(0))
    root: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    depth: int = DEPTH

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x`` (rows x features)."""
        if not len(self.root):
            return np.full(len(x), self.bias)
        rows, at = np.arange(len(x))[:, None], np.broadcast_to(self.root, (len(x), len(self.root)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.split[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that a row is good."""
        return 1 / (1 + np.exp(-self.margin(x)))


def _leaf(g: np.ndarray, h: np.ndarray, low: np.ndarray | float, high: np.ndarray | float) -> np.ndarray:
    return np.clip(-g / (h + PENALTY), low, high)


def _gain(g: np.ndarray, h: np.ndarray, v: np.ndarray) -> np.ndarray:
    return -(2 * g * v + (h + PENALTY) * v * v)


def grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, sign: np.ndarray, depth: int) -> tuple[list[list], np.ndarray]:
    """One tree's nodes (feature, split, left, right, value) and its value for each row. ``bins``: rows x features; ``sign``:
    1 or -1 where the value may only rise or fall with a feature, else 0."""
    nodes, out = [[0, 0.0, 0, 0, 0.0]], np.zeros(len(bins))
    open_ = [(0, np.arange(len(bins)), -np.inf, np.inf, 0)]
    width = BINS + 1
    while open_:
        k, rows, low, high, level = open_.pop()
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = float(_leaf(total_g, total_h, low, high))
        best, chosen = 1e-6, None
        if level < depth and total_h >= 2 * LEAST_WEIGHT:
            at = (bins[rows] + np.arange(bins.shape[1]) * width).ravel()
            spread = lambda v: np.bincount(at, np.repeat(v[rows], bins.shape[1]), bins.shape[1] * width).reshape(-1, width).cumsum(axis=1)
            left_g, left_h = spread(g), spread(h)
            right_g, right_h = total_g - left_g, total_h - left_h
            v, w = _leaf(left_g, left_h, low, high), _leaf(right_g, right_h, low, high)
            gain = _gain(left_g, left_h, v) + _gain(right_g, right_h, w) - _gain(total_g, total_h, own)
            gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT) | (sign[:, None] * (w - v) < 0)] = 0
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, b] > best:
                chosen = int(f), int(b), float(v[f, b] + w[f, b]) / 2
        nodes[k] = [0, 0.0, k, k, own]
        if chosen is None:
            out[rows] = own
            continue
        f, b, middle = chosen
        nodes[k] = [f, float(edges[f][b]), len(nodes), len(nodes) + 1, 0.0]
        nodes += [[], []]
        goes = bins[rows, f] <= b
        left = (low, middle if sign[f] > 0 else high) if sign[f] >= 0 else (middle, high)
        right = (middle if sign[f] > 0 else low, high) if sign[f] >= 0 else (low, middle)
        open_ += [(nodes[k][2], rows[goes], *left, level + 1), (nodes[k][3], rows[~goes], *right, level + 1)]
    return nodes, out


def train(x: np.ndarray, y: np.ndarray, falling: tuple[int, ...] = (), trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Trees for labels ``y`` from 0 to 1. Every fifth row is left out and sets the threshold: LOST of the good ones among
    them are below it. Without both kinds of labels there are no trees, and nothing is below the threshold."""
    fit, rest = np.arange(len(y)) % 5 > 0, np.arange(len(y)) % 5 == 0
    mean = float(np.clip(y[fit].mean(), 1e-6, 1 - 1e-6)) if fit.any() else 0.5
    model = Forest(bias=float(np.log(mean / (1 - mean))), depth=depth)
    if not fit.any() or y[fit].min() == y[fit].max():
        return model
    edges = [np.unique(np.quantile(x[fit, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[fit, f], "left") for f, e in enumerate(edges)], axis=1)  # bin b: at most edge b
    edges = [np.append(e, np.full(BINS + 1 - len(e), np.inf)) for e in edges]
    sign = np.zeros(x.shape[1])
    sign[list(falling)] = -1
    margin, flat = np.full(int(fit.sum()), model.bias), []
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        nodes, value = grow(bins, edges, p - y[fit], np.maximum(p * (1 - p), 1e-9), sign, depth)
        begin = len(flat)
        roots.append(begin)
        flat += [[f, s, a + begin, b + begin, v * RATE] for f, s, a, b, v in nodes]
        margin += RATE * value
    f, s, a, b, v = zip(*flat, strict=True)
    model.feature, model.split, model.left, model.right, model.value, model.root = np.array(f, np.int32), np.array(s), np.array(a, np.int32), np.array(b, np.int32), np.array(v), np.array(roots, np.int32)
    good = np.sort(model.score(x[rest & (y >= 0.5)]))
    model.threshold = min(MOST, float(good[min(len(good) - 1, int(np.ceil(LOST * len(good))))])) if len(good) else 0.0
    return model


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = FIT_ROWS) -> Forest:
    """Trees fitted on ``rows`` labelled documents at most, about, chosen by the hashes of their ids. Null ids and labels
    teach nothing; a document with several labels has their mean, one with several rows its first by statistics."""
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    found = stats.groupBy("id").agg(F.min(F.struct(*FEATURES)).alias("x")).join(own, "id")
    found = stored(found, "labelled")
    every = max(1, -(-found.count() // rows))
    some = found.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).orderBy("id").select("y", "x.*").toPandas()
    return train(some[list(FEATURES)].to_numpy(float), some["y"].to_numpy(float), tuple(FEATURES.index(c) for c in FALLING))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_words, BASE..., base_failed, score, kept) for each row of ``docs``.

    Null, empty and wordless texts have no words and fail the base rules. Repeated rows are judged alike, null ids too;
    other columns are not read. Without labels of both kinds all that pass the base rules are kept. An empty table gives
    an empty result."""
    stats = stored(document_statistics(docs, id_col, text_col), "statistics")
    model = fit(stats, labels, id_col)
    passed = ["id", "n_words", *BASE]
    schema = ", ".join(f"{c} {dict(stats.dtypes)[c]}" for c in passed) + ", score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), pa.array(model.score(x))], [*passed, "score"])

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = stats.select(*passed, *FEATURES).mapInArrow(work, schema).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("score") >= model.threshold)
    return out.select(F.col("id").alias(id_col), "n_words", *BASE, "base_failed", "score", kept.alias("kept"))
