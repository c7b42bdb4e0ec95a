"""Words of whole texts as 64-bit codes, computed over UTF-8 bytes with numpy.

A text is never decoded: classes and lower-casing are byte tables (ASCII only), words are runs of
word bytes, and a word's code is a polynomial hash taken from one running sum per chunk of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is worked on alone.
CHUNK_BYTES = 300_000
#: Bytes of a long text whose sums are held at a time.
PIECE_BYTES = 2_000_000

_rng = np.random.default_rng(20240131)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
LOWER_VALUES = _VALUES[_lower]

#: Words of letters and digits: every byte but the ASCII ones outside 0-9, a-z (A-Z is lower-cased first).
ALNUM = np.ones(256, bool)
ALNUM[:128] = [chr(i).isalnum() for i in range(128)]
#: Words between ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for k, p in enumerate((_P, _P_INVERSE)):
            a = np.full(size, p, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit codes that spreads them."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, start and length of each text of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    length = np.diff(at)
    if column.null_count:
        length = np.where(np.asarray(column.is_valid()), length, 0)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at[:-1], length


def chunks(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, start of each text)``: each text ends with one added space."""
    data, start, length = utf8(column)
    n, lo = len(start), 0
    ends = np.cumsum(length + 1)
    while lo < n:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
        at = np.concatenate(([0], ends[lo:hi] - before))
        out = np.full(at[-1], 32, np.uint8)
        for i in range(lo, hi):
            out[at[i - lo] : at[i - lo] + length[i]] = data[start[i] : start[i] + length[i]]
        yield lo, hi, out, at[:-1]
        lo = hi


def words(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes."""
    m = np.zeros(len(buf) + 2, np.int8)
    m[1:-1] = table[buf]
    d = np.diff(m)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def codes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = LOWER_VALUES) -> np.ndarray:
    """Code of each span of bytes; equal bytes (by ``values``) have equal codes, wherever they stand."""
    if len(buf) <= PIECE_BYTES or not len(start):
        return _codes(buf, start, end, values)
    out, a = np.empty(len(start), np.uint64), 0
    while a < len(start):
        b = a + max(1, int(np.searchsorted(start[a:], start[a] + PIECE_BYTES)))
        lo, hi = int(start[a:b].min()), int(end[a:b].max())
        out[a:b] = _codes(buf[lo:hi], start[a:b] - lo, end[a:b] - lo, values)
        a = b
    return out


def _codes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    power, inverse = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * power[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def text_words(buf: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of a chunk, and the place in it of each text's first word (with the end)."""
    start, end = words(buf, table)
    return codes(buf, start, end), np.concatenate((np.searchsorted(start, at), [len(start)]))
