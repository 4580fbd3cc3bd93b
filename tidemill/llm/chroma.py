"""Chroma audio fingerprints of media columns, and alignment of recordings by them.

Audio becomes frames of energy by pitch class; frames are normalised and summed into an integral image, over which 16
filters (differences of rectangles of frames and pitch classes) are read at each place and quantised to two bits in Gray
code: one 32-bit integer a frame. Recordings are aligned by the histogram of offsets at which they share integers, and
confirmed by the share of bits that differ over the overlap at the commonest offset. The queries, in sets, meet all
recordings, in blocks: a task holds one set and one block, and returns confirmed alignments only.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stored

#: Seconds of a frame and between frames; frames a filter spans.
FRAME_S, HOP_S, SPAN = 0.256, 0.128, 16
LOW_HZ, HIGH_HZ = 60.0, 3520.0
#: A filter's log ratio is quantised at -STEP, 0 and STEP.
STEP = 0.08
#: Places that have to overlap, and most bits that may differ, of a confirmed alignment.
OVERLAP, BIT_ERROR = 24, 0.2
#: Frames that are transformed at once.
AT_ONCE_FRAMES = 2048
#: (kind, first pitch class, pitch classes, frames) of the filters: six kinds in turn over growing widths.
FILTERS = [(n % 6, (5 * n) % 9, 3 + n % 2, 4 + 4 * (n % 4)) for n in range(16)]


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1 to 1 and their rate, of 8-, 16-, 24- or 32-bit PCM."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 3:  # as the upper bytes of 32 bits
        raw, width = np.pad(np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3), ((0, 0), (1, 0))).tobytes(), 4
    kinds = {1: (np.uint8, 128.0, 128.0), 2: (np.dtype("<i2"), 0.0, 32768.0), 4: (np.dtype("<i4"), 0.0, 2147483648.0)}
    kind, zero, scale = kinds[width]
    x = (np.frombuffer(raw, kind).astype(np.float64) - zero) / scale
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by twelve pitch classes of recordings of one length (rows), each frame of length one (zero where silent)."""
    size, hop = int(FRAME_S * rate), int(HOP_S * rate)
    if samples.shape[1] < size or not hop:
        return np.zeros((len(samples), 0, 12))
    hz = np.fft.rfftfreq(size, 1 / rate)
    heard = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    pitch = np.mod(np.rint(12 * np.log2(hz[heard] / 440.0)).astype(int), 12)
    to_class = np.zeros((len(heard), 12))
    to_class[np.arange(len(heard)), pitch] = 1
    window = np.hanning(size)
    frames = np.lib.stride_tricks.sliding_window_view(samples, size, axis=1)[:, ::hop]
    c = np.empty((*frames.shape[:2], 12))
    some = max(1, AT_ONCE_FRAMES // frames.shape[1])
    for i in range(0, len(samples), some):  # bounded memory for many and for long recordings
        for j in range(0, frames.shape[1], AT_ONCE_FRAMES):
            spectrum = np.fft.rfft(frames[i : i + some, j : j + AT_ONCE_FRAMES] * window, axis=2)[..., heard]
            c[i : i + some, j : j + AT_ONCE_FRAMES] = np.sqrt((spectrum.real**2 + spectrum.imag**2) @ to_class)
    norm = np.linalg.norm(c, axis=2, keepdims=True)
    return np.where(norm > 1e-6, c / np.maximum(norm, 1e-6), 0.0)


def integers(frames: np.ndarray) -> np.ndarray:
    """One 32-bit integer (signed) for each recording (row) and each place at which SPAN frames fit."""
    n = frames.shape[1] - SPAN + 1
    if n < 1:
        return np.empty((len(frames), 0), np.int32)
    total = np.zeros((len(frames), frames.shape[1] + 1, 13))
    total[:, 1:, 1:] = frames.cumsum(axis=1).cumsum(axis=2)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[:, at + t1, p1] - total[:, at + t0, p1] - total[:, at + t1, p0] + total[:, at + t0, p0]

    out = np.zeros((len(frames), n), np.uint32)
    for kind, p, high, wide in FILTERS:
        q, half, mid, third, low = p + high, wide // 2, p + high // 2, max(1, wide // 3), p + max(1, high // 3)
        everything = area(0, wide, p, q)
        if kind == 0:  # energy in these classes against all others
            a, b = everything, area(0, wide, 0, 12) - everything
        elif kind == 1:  # upper against lower classes
            a, b = area(0, wide, mid, q), area(0, wide, p, mid)
        elif kind == 2:  # later against earlier frames
            a, b = area(half, wide, p, q), area(0, half, p, q)
        elif kind == 3:  # one diagonal against the other
            a = area(0, half, mid, q) + area(half, wide, p, mid)
            b = everything - a
        elif kind == 4:  # the middle of the frames against the ends
            a = area(third, wide - third, p, q)
            b = everything - a
        else:  # the middle of the classes against the ends
            a = area(0, wide, low, q - 1)
            b = everything - a
        ratio = np.log((1 + a) / (1 + b))
        gray = np.array([0, 1, 3, 2], np.uint32)[np.digitize(ratio, (-STEP, 0.0, STEP))]
        out = (out << np.uint32(2)) | gray
    return out.view(np.int32)


def prints(recordings: list[tuple[np.ndarray, int] | None]) -> list[np.ndarray]:
    """Fingerprints of (samples, rate); those of one length and rate are made together."""
    out = [np.empty(0, np.int32)] * len(recordings)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, r in enumerate(recordings):
        if r is not None:
            alike.setdefault((len(r[0]), r[1]), []).append(i)
    for (_, rate), places in alike.items():
        for i, own in zip(places, integers(chroma(np.stack([recordings[i][0] for i in places]), rate)), strict=True):
            out[i] = own
    return out


def fingerprints(df: DataFrame, id_col: str, media_col: str, read: Callable[[object], tuple[np.ndarray, int]] = decode_wav) -> DataFrame:
    """(``id_col``, fp array<int>) for each row; ``read`` turns a value into samples and rate (by default from WAV).
    Null, unreadable, silent-short or empty media have an empty fingerprint. Repeated rows stay."""

    def heard(x: object) -> tuple[np.ndarray, int] | None:
        try:
            return None if x is None else read(x)
        except (wave.Error, EOFError, ValueError, KeyError):
            return None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                b = whole.slice(i, 64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints([heard(x) for x in b.column(1).to_pylist()]), pa.list_(pa.int32()))], ["id", "fp"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("m")).mapInArrow(work, f"id {kind}, fp array<int>").withColumnRenamed("id", id_col)


#: Recordings of a block, and queries of a set; queries that are aligned at once.
BLOCK, SET, AT_ONCE = 4096, 2048, 32


def _runs(prints: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value, recording, first place and length of each run of equal integers."""
    first = [np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else np.empty(0, np.int64) for p in prints]
    value = np.concatenate([np.empty(0, np.int32), *(p[f] for p, f in zip(prints, first, strict=True))])
    length = np.concatenate([np.empty(0, np.int64), *(np.diff(np.append(f, len(p))) for p, f in zip(prints, first, strict=True) if len(p))])
    return value, np.repeat(np.arange(len(prints)), [len(f) for f in first]), np.concatenate([np.empty(0, np.int64), *first]), length


def alignments(queries: list[np.ndarray], others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, other, offset, bit error) of the confirmed pairs: those that share integers at two places or more at their
    commonest offset (of equals the nearest to zero, then the larger), overlap there in OVERLAP places and differ in
    BIT_ERROR of the bits or fewer. Every place counts: a run of equal integers against a run adds to each offset at which
    they overlap the number of places in which they do."""
    out: list[tuple[int, int, int, float]] = []
    value, owner, place, length = _runs(others)
    order = np.argsort(value, kind="stable")
    value, owner, place, length = value[order], owner[order], place[order], length[order]
    for at in range(0, len(queries), AT_ONCE):
        v, q, t, n_q = _runs(queries[at : at + AT_ONCE])
        low, high = np.searchsorted(value, v, "left"), np.searchsorted(value, v, "right")
        n = high - low
        hit = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair, t, n_q = np.repeat(q, n) * len(others) + owner[hit], np.repeat(t, n), np.repeat(n_q, n)
        wide = n_q + length[hit] - 1  # offsets at which the runs overlap
        step = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        each = lambda x: np.repeat(x, wide)  # noqa: B023, E731
        offset = each(place[hit] - t - n_q + 1) + step
        places = np.minimum(np.minimum(step + 1, each(wide) - step), np.minimum(each(n_q), each(length[hit])))
        pair = each(pair)
        far = 2 * int(np.abs(offset).max(initial=0)) + 1
        key, where = np.unique(pair * far + offset + far // 2, return_inverse=True)
        shared = np.bincount(where, weights=places, minlength=len(key)).astype(np.int64)
        pair, offset = key // far, key % far - far // 2
        several = shared > 1
        pair, offset, shared = pair[several], offset[several], shared[several]
        best = np.lexsort((-offset, np.abs(offset), -shared, pair))
        best = best[np.flatnonzero(np.concatenate(([True], pair[best][1:] != pair[best][:-1])))] if len(best) else best
        for p, o in zip(pair[best].tolist(), offset[best].tolist(), strict=True):
            a, b = queries[at + p // len(others)], others[p % len(others)]
            a, b = a[max(0, -o) :], b[max(0, o) :]
            m = min(len(a), len(b))
            if m >= OVERLAP:
                error = int(np.bitwise_count(a[:m].view(np.uint32) ^ b[:m].view(np.uint32)).sum()) / (32.0 * m)
                if error <= BIT_ERROR:
                    out.append((at + p // len(others), p % len(others), o, error))
    cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
    return np.array(cols[0], np.int64), np.array(cols[1], np.int64), np.array(cols[2], np.int64), np.array(cols[3], np.float64)


def align(prints: DataFrame, is_query: Column, id_col: str) -> DataFrame:
    """One row for each row of ``prints`` (``id_col``, fp): class_id, the smallest id with an equal fingerprint; n_ints;
    fingerprint (MD5 of the integers); for rows of a class that holds a query row, n_matches, and best_match (a
    class_id), best_offset (in frames) and bit_error of the best one, null without.

    A match is another class whose commonest offset of shared integers overlaps OVERLAP places or more with BIT_ERROR of
    the bits or fewer different; the best has the fewest, of equals the smallest id. Recordings with equal fingerprints
    are one class; an empty fingerprint matches nothing. Integers of all places are compared, none is left out.
    """
    own = stored(prints.select(id_col, "fp", F.md5(F.array_join("fp", ",").cast("binary")).alias("fingerprint"), is_query.alias("asks")), "prints")
    classes = own.groupBy("fingerprint").agg(F.min(id_col).alias("class_id"), F.max("asks").alias("asks"), F.first("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes, "classes")
    heard = classes.filter(F.size("fp") > 0)
    counts = heard.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    blocks, sets = max(1, math.ceil(counts["n"] / BLOCK)), max(1, math.ceil(counts["q"] / SET))
    dealt = lambda n: F.pmod(F.xxhash64("class_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = heard.filter("asks").select(dealt(sets).alias("set"), each(blocks).alias("block"), "class_id", "fp")
    right = heard.select(each(sets).alias("set"), dealt(blocks).alias("block"), "class_id", "fp")

    def confirmed(q: pa.Table, c: pa.Table) -> pa.Table:
        prints = lambda t: [np.asarray(x, np.int32) for x in t["fp"].to_numpy()]
        asks, has = q["class_id"].to_numpy(), c["class_id"].to_numpy()
        i, j, offset, error = alignments(prints(q), prints(c))
        other = asks[i] != has[j]
        return pa.table({"query": pa.array(asks[i][other], pa.int64()), "other": pa.array(has[j][other], pa.int64()), "offset": offset[other].astype(np.int32), "bit_error": error[other]})

    matched = left.groupBy("set", "block").cogroup(right.groupBy("set", "block")).applyInArrow(confirmed, "query long, other long, offset int, bit_error double")
    best = matched.groupBy("query").agg(F.count(F.lit(1)).alias("n_matches"), F.min(F.struct("bit_error", "other", "offset")).alias("b"))
    found = classes.select("fingerprint", "class_id", "asks", "n", F.size("fp").alias("n_ints")).join(best.withColumnRenamed("query", "class_id"), "class_id", "left")
    found = found.select(
        "fingerprint", "class_id", "n_ints", "n", F.when(F.col("asks"), F.coalesce("n_matches", F.lit(0))).alias("n_matches"),
        F.col("b.other").alias("best_match"), F.col("b.offset").alias("best_offset"), F.col("b.bit_error").alias("bit_error"),
    )
    return hot_join(own.select(id_col, "fingerprint"), stored(found, "matches"), "fingerprint", "n")


RATE, NOTE_S = 2000, 0.25


def notes_to_audio(vector: list[float] | None) -> tuple[np.ndarray, int]:
    """A recording of a vector: a note for each component, of two octaves and with an overtone. The test tables have no
    media column; this gives each vector one."""
    if not vector:
        return np.zeros(0), RATE
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], np.float64))
    pitch = 110.0 * 2 ** (np.rint(np.clip(12 + 40 * v, 0, 24)) / 12)
    n = int(NOTE_S * RATE)
    phase = 2 * math.pi * np.cumsum(np.repeat(pitch, n)) / RATE
    return 0.6 * np.sin(phase) + 0.3 * np.sin(2 * phase), RATE


def recordings(vectors: DataFrame) -> DataFrame:
    """Fingerprints and alignments of the recordings of ``embeddings``; queries are ids divisible by 50."""
    prints = fingerprints(vectors.select("vec_id", "embedding"), "vec_id", "embedding", notes_to_audio)
    return align(prints, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), "vec_id")
