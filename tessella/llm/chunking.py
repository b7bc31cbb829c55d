"""Content-defined chunks of short byte streams, worked out for a whole batch of streams at once.

A position is a boundary where the rolling hash of the bytes before it is the greatest within ``reach`` positions to
either side: boundaries depend on the bytes near them only, lie more than ``reach`` apart, and a changed byte moves
none but its neighbours. Every stream begins and ends with a boundary.
"""

from __future__ import annotations

import numpy as np

_GEAR = np.random.default_rng(11).integers(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def chunk_batch(streams: list[bytes], reach: int, window: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream number, chunk hash, chunk bytes) of all chunks of all streams; empty streams have none."""
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    data = np.frombuffer(b"".join(streams), dtype=np.uint8)
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        gear = _GEAR[data]
        rolling = gear.copy()
        for k in range(1, window):
            rolling[k:] = rolling[k:] + gear[:-k] * np.uint64(3**k)
        rolling = (rolling ^ (rolling >> np.uint64(31))) * _Q
        score = (rolling >> np.uint64(16)).astype(np.int64)
        owner = np.repeat(np.arange(len(streams)), sizes)
        offset = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - offset
        score[(offset < window - 1) | (left <= 1)] = -1
        padded = np.concatenate((np.full(reach, -1), score, np.full(reach, -1)))
        most = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1).max(axis=1)
        last = (score == most) & (score >= 0) & (offset >= reach) & (left > reach)
        last |= left == 1
        ends = np.flatnonzero(last) + 1
        begins = np.concatenate(([0], ends[:-1]))
        powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, _P, dtype=np.uint64))))
        sums = np.concatenate(([np.uint64(0)], np.add.accumulate((data.astype(np.uint64) + np.uint64(1)) * powers)))
        inverse = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, _P_INVERSE, dtype=np.uint64))))
        hashes = (sums[ends] - sums[begins]) * inverse[begins]
        hashes = (hashes ^ (hashes >> np.uint64(29))) * _Q
    return owner[begins], hashes.view(np.int64), ends - begins
