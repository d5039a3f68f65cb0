"""64-bit hashes of byte ranges, many at once: polynomials modulo 2**64 over prefix sums, then mixed."""

from __future__ import annotations

import numpy as np

PART = 1 << 20  # bytes hashed at once
_B = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for name, base in (("up", _B), ("down", pow(_B, -1, 1 << 64))):
            p = np.full(PART + 1, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Part:
    """Bytes hashed so that any range's hash takes a few operations."""

    def __init__(self, data: bytes):
        self.raw = np.frombuffer(data, dtype=np.uint8)
        self.up, self.down = _powers()
        values = (self.raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(self.raw)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])

    def hashes(self, start, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])
