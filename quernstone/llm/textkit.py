"""Vectorised text primitives over Arrow string buffers.

Everything works on the UTF-8 bytes of a whole Arrow batch at once (no Python
loop over documents), in slices of bounded size so that a worker's memory does
not depend on the batch or on how long one text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into wide numpy arrays at a time.
SLICE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that mixes all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte.
BYTE_VALUES = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

#: 1 for bytes that belong to words: ASCII letters and digits, and all of a multi-byte character.
WORD_BYTE = np.array([chr(b).isalnum() or b >= 128 for b in range(128)] + [True] * 128, dtype=bool)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i below at least n."""
    have = next(iter(_powers.values()), None)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 64)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _BASE_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        _powers.clear()
        _powers[size] = have
    return have


def utf8(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(column) else raw[:0], offsets - offsets[0]


def slices(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, piece offsets, text number of each piece), of about SLICE_BYTES each.

    A text above SLICE_BYTES is cut before a byte that isn't part of a word, the first from there
    on: no word is cut, and where a text is cut depends on it alone.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        start = int(offsets[i])
        j = int(np.searchsorted(offsets, start + SLICE_BYTES, side="right")) - 1
        if j > i:
            yield raw[start : offsets[j]], offsets[i : j + 1] - start, np.arange(i, j)
            i = j
            continue
        end, at = int(offsets[i + 1]), start
        while at < end:
            to = min(end, at + SLICE_BYTES)
            while to < end:
                gaps = np.flatnonzero(~WORD_BYTE[raw[to : min(end, to + 4096)]])
                if len(gaps):
                    to += int(gaps[0])
                    break
                to = min(end, to + 4096)
            yield raw[at:to], np.array([0, to - at]), np.array([i])
            at = to
        i += 1


def distinct_words(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, hash) of the different words of whole lower-cased texts, sorted, some texts at a time; a long text comes once, by itself."""
    long: list[np.ndarray] = []
    own = -1
    for part, bounds, rows in slices(*utf8(column, lower=True)):
        h, _, piece = words(part, bounds)
        if long and (len(rows) > 1 or rows[0] != own):
            yield _one(own, long)
            long = []
        if len(rows) == 1:  # maybe a piece of a longer text
            own = int(rows[0])
            long = [np.unique(np.concatenate([*long, h]))]
            continue
        order = np.lexsort((h, piece))
        h, piece = h[order], piece[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (piece[1:] != piece[:-1])
        yield rows[piece[new]], h[new]
    if long:
        yield _one(own, long)


def _one(row: int, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.full(len(hashes[0]), row, dtype=np.int64), hashes[0]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, piece number) of each word, in order."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = WORD_BYTE[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    edge = first[:-1]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    up, down = _power_table(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[raw] * up[: len(raw)], out=sums[1:])
    return splitmix((sums[ends] - sums[starts]) * down[starts]), starts, np.searchsorted(offsets, starts, side="right") - 1
