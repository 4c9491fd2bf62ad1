"""Small NumPy helpers over Arrow string arrays, used inside Spark tasks.

A batch of texts is handled as one UTF-8 byte buffer plus document offsets, so no
Python string is made per word.  Words are the runs ``[^\\x20\\x09-\\x0D]+``; word hashes
ignore the case of A-Z.  All hashes are 64 bits, computed from the bytes alone, and so
equal in every task and every run.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def give_back() -> None:
    """Return freed memory and the power tables to the system; Spark keeps idle Python workers for later tasks."""
    import ctypes

    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on every platform
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """``run`` (batches -> batches) that gives its memory back when the task ends."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


MAX_CHUNK_BYTES = 1 << 19  # text bytes handled at once; a longer single text is a chunk of its own


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser (a bijection of 64-bit words)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` well-spread odd 64-bit constants."""
    base = U64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
    with np.errstate(over="ignore"):
        return mix64(base + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = seeds(256, 11)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 2**64)
_NGRAM = seeds(16, 12)


def _power_row(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=U64)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _power_row(_B, n), _power_row(_BINV, n)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size > 1 << 23:  # a very long single text: not cached
        return _power_row(_B, n + 1), _power_row(_BINV, n + 1)
    return _powers(size)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(texts: pa.Array, max_bytes: int = MAX_CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices ``(from_row, to_row, bytes, offsets)`` of at most ``max_bytes`` (or one text)."""
    raw, offsets = buffers(texts)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n+1 positions of each document's first word."""
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[raw]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    before[first] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_counts(texts: pa.Array) -> np.ndarray:
    """Number of words of each text."""
    parts = [np.diff(word_spans(raw, offsets)[2]) for _, _, raw, offsets in chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span (equal bytes give equal hashes)."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    up, down = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(raw) + 1, dtype=U64)
        sums[0] = 0
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * up[: len(raw)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all documents in order, and n+1 positions of each document's first word."""
    starts, ends, first = word_spans(raw, offsets)
    return span_hashes(raw, starts, ends), first


def ngrams(h: np.ndarray, first: np.ndarray, n: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n`` consecutive words within a document, and n+1 positions per document.

    With ``whole_if_short`` a document of 1 to n-1 words yields its whole sequence as one.
    """
    count = np.diff(first)
    per_doc = np.maximum(count - n + 1, 0)
    total = len(h)
    with np.errstate(over="ignore"):
        if total >= n:
            acc = np.zeros(total - n + 1, dtype=U64)
            for k in range(n):
                acc += h[k : total - n + 1 + k] * _NGRAM[k]
            acc = mix64(acc)
            ok = np.ones(total - n + 1, dtype=bool)
            for k in range(1, n):  # a window may not start in the last n-1 words of a document
                at = first[1:][count >= 1] - k
                at = at[(at >= 0) & (at < len(ok))]
                ok[at] = False
            short = np.flatnonzero((count > 0) & (count < n))
            for d in short:
                ok[first[d] : min(first[d + 1], len(ok))] = False
            acc = acc[ok]
        else:
            acc = np.zeros(0, U64)
            short = np.flatnonzero((count > 0) & (count < n))
        if whole_if_short and len(short):
            extra = np.zeros(len(short), U64)
            for i, d in enumerate(short):
                w = h[first[d] : first[d + 1]]
                extra[i] = mix64(np.add.reduce(w * _NGRAM[: len(w)], keepdims=True) + U64(len(w)) * _NGRAM[15])[0]
            at = np.concatenate([[0], np.cumsum(per_doc)])[short]
            acc = np.insert(acc, at, extra)
            per_doc = per_doc.copy()
            per_doc[short] = 1
    return acc, np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int64)


def segment(ufunc: np.ufunc, values: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    """``ufunc.reduceat`` over document segments (along axis 0); ``empty`` where a segment has no value."""
    n = len(first) - 1
    out = np.full((n, *values.shape[1:]), empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, first[full], axis=0)
    return out


def lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and number of words of each line that has words, and n+1 positions of each document's first line.

    Lines end at ``\\n``; equal word sequences (A-Z in any case, any white space) give equal hashes.
    """
    starts, ends, first = word_spans(raw, offsets)
    if len(starts) == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    h = span_hashes(raw, starts, ends)
    breaks = np.searchsorted(np.flatnonzero(raw == 10), starts)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = breaks[1:] != breaks[:-1]
    new[first[:-1][first[:-1] < len(starts)]] = True
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    inside = np.arange(len(starts)) - np.repeat(at, count)
    up, _ = _power_tables(int(count.max()))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(h * up[inside], at)
        return mix64(sums + count.astype(U64) * _NGRAM[14]), count, np.searchsorted(at, first)
