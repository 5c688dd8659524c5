"""Vectorised hashing of words, shingles and byte strings inside tasks."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240917)
TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):                      # A-Z hash as a-z
    TABLE[_c] = TABLE[_c + 32]
PLAIN = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
P = 0x9E3779B97F4A7C15 | 1
INV = pow(P, -1, 2**64)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((P, INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(buf: np.ndarray, starts: np.ndarray, live: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """Hash of the live bytes from each start to the next one."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(buf))
    part = table[buf] * up
    part[~live] = 0
    return mix(np.add.reduceat(part, starts) * down[starts])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space, A-Z lower-cased)
    of some texts, and the offsets of each text's words in them."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    blank = BLANK[buf]
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    ends = np.cumsum([len(r) + 1 for r in raw])
    return spans(buf, starts, ~blank), np.r_[0, np.searchsorted(starts, ends)]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole, if it has fewer."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    out = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(P) + h[j:n - k + 1 + j]
    return mix(out)
