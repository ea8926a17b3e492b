"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on the UTF-8 buffers of Arrow string columns, in blocks of
bounded size, so no Python string is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: bytes of text handled in one vectorised step (a longer text is a step of its own)
BLOCK_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_Q = [pow(0xD1342543DE82EF95, j, 1 << 64) for j in range(64)]
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)

#: separators: ASCII white space / everything ASCII that is neither letter nor digit
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer (a bijection of 64-bit words)."""
    x = x.copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as uniforms of the open interval (0, 1)."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            steps = np.full(size, _P, np.uint64)
            steps[0] = 1
            back = np.full(size, _P_INV, np.uint64)
            back[0] = 1
            _pow, _inv = np.cumprod(steps, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return _pow, _inv


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if off is not None and len(col) else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows: row number, start, end (bytes) and 64-bit hash of each."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    inside = ~separators[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, back = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
        h = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start, end, h


def shingles(row: np.ndarray, h: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``size`` words; a row with 1 to size-1 words has one shingle of all of them."""
    n = len(h)
    if not n:
        return row, h
    with np.errstate(over="ignore"):
        out_row, out_h = [], []
        if n >= size:
            m = n - size + 1
            total = np.zeros(m, np.uint64)
            for j in range(size):
                total += h[j : j + m] * U(_Q[j])
            whole = row[:m] == row[size - 1 :]
            out_row.append(row[:m][whole])
            out_h.append(mix(total[whole]))
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        count = np.diff(np.r_[at, n])
        for i in np.flatnonzero(count < size):
            a = at[i]
            part = h[a : a + count[i]] * np.array(_Q[: count[i]], np.uint64)
            out_row.append(row[a : a + 1])
            out_h.append(mix(np.array([part.sum(dtype=np.uint64) + U(count[i])], np.uint64)))
    r, s = np.concatenate(out_row), np.concatenate(out_h)
    order = np.argsort(r, kind="stable")
    return r[order], s[order]


#: bits of a shingle's hash that counting and sketches keep, beside 20 for the row within a block
HASH_BITS = 44


def counted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in ascending order, and how often each occurs; hashes keep their HASH_BITS upper bits."""
    if not len(h):
        return row, h, np.zeros(0, np.int64)
    key = np.sort((row.astype(np.uint64) << U(HASH_BITS)) | (h >> U(64 - HASH_BITS)))
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return (key[at] >> U(HASH_BITS)).astype(np.int64), key[at] & U((1 << HASH_BITS) - 1), np.diff(np.r_[at, len(key)])


def lowered(col: pa.Array) -> pa.Array:
    """The column in lower case (by Unicode's simple mapping)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.utf8_lower(col if pa.types.is_string(col.type) else col.cast(pa.string()))
