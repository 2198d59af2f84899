"""Words of whole Arrow string columns as numpy arrays.

A word is a longest run of a-z and 0-9 after lower-casing. Spans and 64-bit hashes of all words of a batch come from
passes over its byte buffer, without a Python object per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in slices of about this many bytes, which bounds the working memory.
SLICE_BYTES = 1 << 20

_FOLD = np.zeros(256, dtype=np.uint8)
for _c in range(256):
    if 48 <= _c <= 57 or 97 <= _c <= 122:
        _FOLD[_c] = _c
    elif 65 <= _c <= 90:
        _FOLD[_c] = _c + 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Other letters whose lower case begins with a plain letter, as fixed values: Kelvin sign, capital I with dot.
_LOWER_TO_PLAIN = {"K": "k", "İ": "i̇"}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of texts first..first+n_texts-1 of a column: text number, byte span in data, hash."""

    first: int
    n_texts: int
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("ascii").lower()


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        up, down = np.full(size, _ODD, np.uint64), np.full(size, _ODD_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def column_words(column: pa.Array):
    """Yield the Words of consecutive slices of a string column; null counts as empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    for odd, plain in _LOWER_TO_PLAIN.items():
        if odd.encode() in (column.buffers()[2] or pa.py_buffer(b"")).to_pybytes():
            column = pc.replace_substring(column, odd, plain)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield _words(whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last


def _words(data: np.ndarray, offsets: np.ndarray, first: int) -> Words:
    n = len(data)
    low = _FOLD[data]
    inside = low != 0
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        heads, tails = offsets[:-1], offsets[1:] - 1
        before[heads[heads < n]] = False
        after[tails[(tails >= 0)]] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    text = np.searchsorted(offsets, start, "right") - 1
    return Words(first, len(offsets) - 1, text, start, end, h, data)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; the caller leaves out those that cross texts."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    return mix(out)
