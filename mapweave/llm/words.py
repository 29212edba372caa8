"""Words of whole texts as 64-bit hashes, for numpy inside Arrow tasks.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; A-Z are
lower-cased.  Hashes are polynomials with random byte values modulo 2**64, mixed at the end, so equal words have equal
hashes and a clash of two of a thousand million words is unlikely (about 3 in 100).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
_BLOCK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
VALUE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
FOLDED = VALUE[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP: np.ndarray | None = None
_DOWN: np.ndarray | None = None


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if _UP is None or len(_UP) < n:
        _UP, _DOWN = _powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 2**64), n)
    return _UP, _DOWN


def mix(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the place where each begins (one more place at the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    if len(texts) == 0 or places is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(places, wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize).astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def bounds(data: np.ndarray, at: np.ndarray, of_word: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in the bytes, and the number of the first word of each text (one more at the end)."""
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    inside = of_word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside
    end[:-1] &= ~inside[1:] | cut[1:-1]
    begins = np.flatnonzero(begin)
    return begins, np.flatnonzero(end) + 1, np.searchsorted(begins, at)


def hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, value: np.ndarray = FOLDED) -> np.ndarray:
    """A hash per word, block by block so that memory stays bounded."""
    out = np.empty(len(begins), np.uint64)
    i = 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + _BLOCK, "right")))
        lo, hi = int(begins[i]), int(ends[j - 1])
        up, down = _tables(max(_BLOCK, hi - lo) + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(value[data[lo:hi]] * up[: hi - lo], out=total[1:])
        b, e = begins[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[b]) * down[b] + (e - b).astype(np.uint64))
        i = j
    return out


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows with about ``size`` bytes of text each, so that arrays made of them stay small."""
    _, at = buffer_of(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = min(batch.num_rows, max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1))
        yield batch.slice(i, j - i)
        i = j


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of each text's first word (one more at the end)."""
    data, at = buffer_of(texts)
    begins, ends, first = bounds(data, at)
    return hashes(data, begins, ends), first
