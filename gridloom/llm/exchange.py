"""Golomb-Rice codes for sorted lists of 64-bit fingerprints."""

from __future__ import annotations

import numpy as np


def rice_parameter(n: int, span: int) -> int:
    """Bits of the remainder: about log2(ln 2 times the mean gap)."""
    if n == 0:
        return 0
    return max(0, min(62, int(span * 0.6931 / n).bit_length() - 1))


def encode(values: np.ndarray, base: int, span: int) -> tuple[bytes, int]:
    """Code sorted distinct uint64 values of [base, base + span): unary quotients, then remainders.

    Gaps g split into q = g >> k, written as q zeros and a one, and the k low
    bits. Gaps are geometric for uniform hashes, for which this is Golomb's code
    with a power of two.
    """
    n = len(values)
    k = rice_parameter(n, span)
    if n == 0:
        return b"", k
    gaps = np.diff(values, prepend=np.uint64(base))
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    head = np.packbits(unary).tobytes()
    if k:
        low = ((gaps[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        tail = np.packbits(low).tobytes()
    else:
        tail = b""
    return len(head).to_bytes(8, "little") + head + tail, k


def decode(code: bytes, n: int, k: int, base: int) -> np.ndarray:
    if n == 0:
        return np.empty(0, np.uint64)
    cut = 8 + int.from_bytes(code[:8], "little")
    unary = np.unpackbits(np.frombuffer(code[8:cut], np.uint8))
    ends = np.flatnonzero(unary)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(np.frombuffer(code[cut:], np.uint8), count=n * k).reshape(n, k)
        weights = np.uint64(1) << np.arange(k - 1, -1, -1, dtype=np.uint64)
        gaps += (low * weights).sum(axis=1, dtype=np.uint64)
    return np.uint64(base) + np.cumsum(gaps, dtype=np.uint64)
