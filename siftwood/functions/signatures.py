"""Which of many signatures a text contains, by hashed windows of bytes: exact, and one pass over each text."""

from __future__ import annotations

import numpy as np

#: A signature is looked up by its first bytes, as many as the first of these that it has; a shorter one by itself.
SIZES = (32, 8)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def windows(raw: bytes, size: int) -> np.ndarray:
    """The hash of the size bytes (a multiple of 8) at each place of raw."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    signs = np.frombuffer(raw, np.uint8).astype(np.uint64)
    eight = np.zeros(len(raw) - 7, np.uint64)
    for k in range(8):
        eight |= signs[k : k + len(eight)] << np.uint64(8 * k)
    out = np.zeros(n, np.uint64)
    for k in range(0, size, 8):
        out = (out ^ eight[k : k + n]) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


class SignatureIndex:
    """Signatures in order; of those that a text contains, the first is told."""

    def __init__(self, signatures: list[bytes]):
        self.signatures = signatures
        self.plain = [k for k, s in enumerate(signatures) if len(s) < SIZES[-1]]
        self.tables = []
        for size, above in zip(SIZES, (1 << 62, *SIZES)):
            ranks = np.array([k for k, s in enumerate(signatures) if size <= len(s) < above], np.int64)
            if not len(ranks):
                continue
            h = np.concatenate([windows(signatures[k][:size], size) for k in ranks.tolist()])
            order = np.argsort(h, kind="stable")  # of equal hashes the first signature stays first
            bits = min(26, max(16, int(len(h) * 64).bit_length()))
            shift, table = np.uint64(64 - bits), np.zeros(1 << bits, bool)
            table[h >> shift] = True
            self.tables.append((size, h[order], ranks[order], shift, table))

    def first(self, raw: bytes) -> int | None:
        best = next((k for k in self.plain if self.signatures[k] in raw), len(self.signatures))
        for size, hashes, ranks, shift, table in self.tables:
            h = windows(raw, size)
            at = np.flatnonzero(table[h >> shift])
            low, high = (np.searchsorted(hashes, h[at], side) for side in ("left", "right"))
            for place, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
                for k in ranks[a:b].tolist():
                    if k >= best:
                        break
                    if raw.startswith(self.signatures[k], place):
                        best = k
        return best if best < len(self.signatures) else None
