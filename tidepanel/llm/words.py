"""64-bit names of words, computed for many texts at once."""

from __future__ import annotations

import numpy as np

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
# One random code per byte value.
CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_CODES = CODES.copy()
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]  # A-Z count as lower case
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _powers_up_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def span_names(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Names of the byte spans of ``raw``: a polynomial over the bytes' codes, read off running sums and shifted to the span's start."""
    forward, back = _powers_up_to(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes[raw] * forward[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_names(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(names of all words in order, number of words of each text).

    A word is a run of bytes that are no ASCII white space; equal words have equal names wherever they stand.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    names = span_names(raw, starts, ends, _CODES)
    bounds = np.cumsum([len(e) + 1 for e in encoded])
    return names, np.diff(np.searchsorted(starts, bounds), prepend=0)
