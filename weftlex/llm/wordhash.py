"""Vectorised word hashing over Arrow string buffers.

Words are the maximal runs of bytes outside a separator table.  A whole block
of texts is hashed at once: one cumulative sum of ``T[byte] * P**i`` gives every
prefix hash modulo 2**64, so each word's Karp-Rabin hash is one subtraction and
one multiplication by ``P**-start``.  Memory is bounded by ``BLOCK_BYTES``
(plus one word), not by the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 3)
_MASK = (1 << 64) - 1
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))

#: Separators of the contract's words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators that leave letters and digits only (bytes of non-ASCII letters stay).
NON_ALNUM = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWERED = _TABLE[_LOWER]
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for key, base in (("p", _P), ("q", _PINV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[key] = np.cumprod(out, dtype=np.uint64)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _block(data: np.ndarray, doc_starts: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of one block; a word ends at a text's start too."""
    gap = sep[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = gap[:-1]
    edge[doc_starts] = True
    starts = np.flatnonzero(edge[:-1] & ~gap)
    edge[:-1] = gap
    edge[doc_starts] = True
    edge[-1] = True
    # the end of the word at s is the first edge after s
    stops = np.flatnonzero(edge)
    ends = stops[np.searchsorted(stops, starts + 1)]
    p, q = _pow(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWERED[data] * p[: len(data)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * q[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64))


def punctuation(data: np.ndarray) -> np.ndarray:
    """Bytes that are no part of letters or digits: NON_ALNUM, and the UTF-8 of Latin, general, East Asian and full-width punctuation and symbols."""
    gap = NON_ALNUM[data]
    if not (data >= 0xC2).any():
        return gap
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    b, c = pad[1:-1], pad[2:]
    at = np.flatnonzero((data == 0xC2) & ~np.isin(b, [0xAA, 0xB5, 0xBA]) | (data == 0xC3) & np.isin(b, [0x97, 0xB7]))
    gap[at] = gap[at + 1] = True
    wide = (data == 0xE2) & ((b == 0x80) | (b == 0x81) & (c < 0xB0) | (b >= 0x86) & (b <= 0xAF)) | (data == 0xE3) & (b == 0x80) & ((c < 0x85) | (c > 0x87))
    wide |= (data == 0xEF) & ((b == 0xBC) & ((c < 0x90) | (c >= 0x9A) & (c <= 0xA0) | (c >= 0xBB)) | (b == 0xBD) & ((c == 0x80) | (c >= 0x9B) & (c <= 0xA5)))
    at = np.flatnonzero(wide)
    for k in range(3):
        gap[np.minimum(at + k, len(gap) - 1)] = True
    return gap


def substrings(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Hashes of the byte runs [a, b) of ``data``, ASCII letters lowered, from one prefix sum."""
    p, q = _pow(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWERED[data] * p[: len(data)], out=prefix[1:])
    return lambda a, b: mix((prefix[b] - prefix[a]) * q[a] + (b - a).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def words(column: pa.Array, sep: np.ndarray = SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts: (first row, past last row, word hashes, row bounds in them).

    ``hashes[bounds[i]:bounds[i + 1]]`` are the words of row ``first + i``.
    """
    data, offsets = buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        lo, hi = offsets[row], offsets[stop]
        if hi - lo <= BLOCK_BYTES:
            starts, hashes = _block(data[lo:hi], offsets[row:stop] - lo, sep)
            yield row, stop, hashes, np.searchsorted(starts, offsets[row : stop + 1] - lo)
        else:  # one long text: pieces that end at a separator
            parts = []
            while lo < hi:
                end = min(lo + BLOCK_BYTES, hi)
                while end < hi and not len(found := np.flatnonzero(sep[data[lo:end]])):
                    end = min(end + BLOCK_BYTES, hi)
                if end < hi:
                    end = lo + int(found[-1]) + 1
                parts.append(_block(data[lo:end], np.zeros(1, np.int64), sep)[1])
                lo = end
            hashes = np.concatenate(parts)
            yield row, stop, hashes, np.array([0, len(hashes)])
        row = stop


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words, as if all words were of one text."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    out, factor = np.zeros(n, np.uint64), 1
    for k in range(width):
        factor = factor * 0xD1342543DE82EF95 & _MASK
        out += hashes[k : k + n] * np.uint64(factor)
    return mix(out)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each text.

    Fewer words than ``width``: the whole sequence is the one shingle; no word: empty.
    """
    for first, _, hashes, bounds in words(column):
        runs = windows(hashes, width)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b - a >= width:
                yield first + i, np.unique(runs[a : b - width + 1])
            elif b > a:
                yield first + i, mix(windows(hashes[a:b], b - a) + np.uint64(b - a))
            else:
                yield first + i, hashes[:0]
