"""Texts of an Arrow column as one byte array, and vectorised word hashes."""

from __future__ import annotations

import numpy as np


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): the UTF-8 bytes of a string column without a copy, and
    the n + 1 offsets of its rows.  A null row is empty."""
    import pyarrow as pa

    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1]
    ends = ends.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0]:ends[-1]], ends - ends[0]


def texts_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    return column_bytes(pa.array(texts, pa.string()))


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    base = np.uint64(0x9E3779B97F4A7C15)
    for i in range(1, n):
        out[i] = out[i - 1] * base
    return out


_POWER_STEP = 64
with np.errstate(over="ignore"):
    _POWERS = _powers(1 << 12)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_spans(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, row) of the runs of True in ``inside``, cut at row ends."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = ends[:-1]
    before[first[first < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = ends[1:] - 1
    after[last[last >= 0]] = False
    stop = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(ends, start, "right") - 1
    return start, stop, row


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes (equal bytes, equal hash)."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        lengths = stop - start
        base = np.repeat(start, lengths)
        idx = np.arange(int(lengths.sum()), dtype=np.int64)
        firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        within = idx - np.repeat(firsts, lengths)
        values = data[base + within].astype(np.uint64) + np.uint64(1)
        # a long word's later stretches take their power from two factors
        low = _POWERS[within % len(_POWERS)]
        high = within // len(_POWERS)
        if len(high) and high.max():
            low = low * mix(high.astype(np.uint64) + np.uint64(1))
        sums = np.add.reduceat(values * low, firsts)
        return mix(sums ^ mix(lengths.astype(np.uint64)))
