"""Vectorised word tables: every word of a column of texts, hashed, without a Python loop per word.

A *word* is a maximal run of ASCII letters, digits and non-ASCII bytes of the lower-cased text; any other ASCII byte
separates. A word's hash is 64 bits of a polynomial over its bytes, taken from prefix sums, so that a word may be as
long as it likes and a text is only ever looked at in chunks of CHUNK bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)

WORD_BYTE = np.zeros(256, dtype=bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    WORD_BYTE[list(_r)] = True


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: list[np.ndarray] = []


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & _MASK)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def string_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word, in order. No word crosses an offset."""
    if not _POW:
        _POW.extend([_powers(_BASE), _powers(_INVERSE)])
    power, inverse = _POW
    starts, ends, start_sum, end_sum, undo = [], [], [], [], []
    carry, open_word = np.uint64(0), False
    n = len(data)
    with np.errstate(over="ignore"):
        for at in range(0, n, CHUNK):
            b = data[at : at + CHUNK]
            m = len(b)
            w = WORD_BYTE[b]
            before = np.empty(m, dtype=bool)
            before[0], before[1:] = open_word, w[:-1]
            forced = np.zeros(m, dtype=bool)
            lo, hi = np.searchsorted(offsets, (at, at + m))
            forced[offsets[lo:hi] - at] = True
            factor = np.uint64(pow(_BASE, at, 1 << 64))
            terms = (b.astype(np.uint64) + np.uint64(1)) * power[:m]
            sums = np.cumsum(terms)
            s = np.flatnonzero(w & (~before | forced))
            e = np.flatnonzero(before & (~w | forced))
            starts.append(s + at)
            ends.append(e + at)
            start_sum.append(carry + factor * (sums[s] - terms[s]))
            end_sum.append(carry + factor * (sums[e] - terms[e]))
            undo.append(inverse[s] * np.uint64(pow(_INVERSE, at, 1 << 64)))
            carry = carry + factor * sums[-1]
            open_word = bool(w[-1])
        if open_word:
            ends.append(np.array([n]))
            end_sum.append(np.array([carry], dtype=np.uint64))
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        start, end = np.concatenate(starts), np.concatenate(ends)
        h = (np.concatenate(end_sum) - np.concatenate(start_sum)) * np.concatenate(undo)
    return start, end, mix(h + (end - start).astype(np.uint64))


def lowered(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return string_parts(pc.utf8_lower(arr.cast(pa.large_string())))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most max_bytes of text each, or of one row where that alone is larger."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def rows_of(start: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(offsets, start, side="right") - 1


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes; empty if there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, k):
            out = mix(out) + h[i : i + n]
    return mix(out, 7)
