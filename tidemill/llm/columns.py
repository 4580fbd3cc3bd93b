"""Words and lines of many texts at once, by numpy on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; a longer text is a block of its own.
BLOCK = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def blocks(batches: Iterator[pa.RecordBatch], text: int, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Batches cut where ``size`` bytes of column ``text`` are full."""
    for b in batches:
        begin = 0
        if b.num_rows:
            ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
            while begin < b.num_rows:
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + size, "right")))
                yield b.slice(begin, end - begin)
                begin = end


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in a row, and where each begins, with the end of the last; a null text is empty."""
    t = pa.compute.fill_null(text, "").cast(pa.large_string())
    offsets = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    data = np.frombuffer(t.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if t.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def running(flags: np.ndarray) -> np.ndarray:
    """How many flags hold up to each place, its own included."""
    return np.cumsum(flags, dtype=np.int32 if len(flags) < 1 << 31 else np.int64)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The runs of bytes for which the table ``inside`` (256 flags) holds, none across texts: the words, where each begins
    and which text it is of."""
    own = inside[data]
    before = np.concatenate(([False], own[:-1])) if len(own) else own.copy()
    before[offsets[:-1][offsets[:-1] < len(own)]] = False
    starts = np.flatnonzero(own & ~before)
    kept = data[own]
    at = running(own)[starts] - 1
    ends = np.append(at, len(kept)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(_LOWER[kept] if lower else kept))])
    return found, starts, np.searchsorted(offsets, starts, "right") - 1


def coded(found: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, and the words by number."""
    d = found.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags hold in each text's bytes."""
    return np.diff(np.concatenate(([0], running(flags)))[offsets]).astype(np.int64)
