"""Words of many texts as arrays: 64-bit hashes and byte positions, computed on an Arrow buffer without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)
VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
#: Bytes of texts that are worked on together, unless one text is longer.
BLOCK = 2 << 20
#: Bytes that running sums cover at once.
PIECE = 4 << 20

_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i < n, modulo 2 ** 64."""
    while len(_powers[0]) < n:
        k = len(_powers[0])
        for i, b in enumerate((BASE, INVERSE)):
            _powers[i] = np.concatenate((_powers[i], _powers[i] * U(pow(b, k, 1 << 64))))
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after) of each word of the texts joined by blanks, and the texts' offsets among the words.

    Sums run over pieces of about PIECE bytes that end at a blank, so that a long text needs a few times its size, most of
    that for the words' arrays. A single word longer than a piece is one piece.
    """
    joined = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    parts, at = [], 0
    while at < len(joined):
        end = min(at + PIECE, len(joined))
        while end < len(joined) and not BLANK[joined[end - 1]]:
            later = np.flatnonzero(BLANK[joined[end : end + PIECE]])
            end = end + int(later[0]) + 1 if len(later) else min(end + PIECE, len(joined))
        parts.append(piece(joined[max(0, at - 1) : end], lower, max(0, at - 1)))
        at = end
    h, first, after = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, first, after, np.searchsorted(first, ends)


def piece(joined: np.ndarray, lower: bool, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after) of each word of bytes that begin and end with a blank and stand at ``shift``."""
    if lower:
        joined = LOWER[joined]
    edge = np.flatnonzero(np.diff(BLANK[joined].view(np.int8)))
    first, after = edge[0::2] + 1, edge[1::2] + 1
    up, down = powers(len(joined) + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(VALUE[joined] * up[: len(joined)], dtype=U)))
    return mixed((sums[after] - sums[first]) * down[first]), first + shift, after + shift


def blocks(column: pa.Array):
    """(index of the first row, texts as bytes) for neighbouring rows of a string or binary column; null is empty."""
    lo, part, size = 0, [], 0
    for i, x in enumerate(column):
        t = x.as_buffer().to_pybytes() if x.is_valid else b""
        if part and size + len(t) > BLOCK:
            yield lo, part
            lo, part, size = i, [], 0
        part.append(t)
        size += len(t)
    if part:
        yield lo, part


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` neighbours, len(h) - k + 1 of them."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, U(seed * 2 + 1))
    for i in range(k):
        out = out * U(BASE) + h[i : i + n]
    return mixed(out)
