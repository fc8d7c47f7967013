"""Context-triggered piecewise hashes (the ssdeep form): equal parts of two files give equal parts of their hashes."""

from __future__ import annotations

import numpy as np

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, LENGTH, SMALLEST = 7, 64, 3
#: The low six bits of the piece hash's factor and start, all that a piece's sign depends on.
FACTOR, START = 0x01000193 & 63, 0x28021967 & 63


def rolling(raw: np.ndarray) -> np.ndarray:
    """The rolling hash behind each byte: sums over the window, plain and weighted, and its shifted exclusive-or."""
    padded = np.concatenate((np.zeros(WINDOW, np.uint32), raw.astype(np.uint32)))
    n = len(raw)
    plain, weighted, shifted = (np.zeros(n, np.uint32) for _ in range(3))
    for k in range(WINDOW):  # k bytes back
        part = padded[WINDOW - k : WINDOW - k + n]
        plain += part
        weighted += np.uint32(WINDOW - k) * part
        shifted ^= part << np.uint32(5 * k)
    return plain + weighted + shifted


def _ends(raw: np.ndarray, size: int, step: int = 1 << 20) -> np.ndarray:
    """Where pieces of a block size end, a stretch of the file at a time."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(raw), step):
        lead = min(at, WINDOW)
        roll = rolling(raw[at - lead : at + step])[lead:]
        found.append(np.flatnonzero(roll % np.uint32(size) == size - 1) + at)
    return np.concatenate(found)


def _pieces(raw: np.ndarray, ends: np.ndarray, most: int) -> str:
    """A sign for each piece: the first most - 1, and one for all that is left."""
    starts = np.concatenate(([0], ends[: most - 1] + 1)).astype(np.int64)
    stops = np.concatenate((starts[1:], [len(raw)]))
    hashes = np.full(len(starts), START, np.uint8)
    sizes = stops - starts
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, hashes = starts[order], sizes[order], hashes[order]
    live = len(starts)
    for k in range(int(sizes.max(initial=0))):  # all pieces side by side
        while live and sizes[live - 1] <= k:
            live -= 1
        hashes[:live] = (hashes[:live] * np.uint8(FACTOR) & 63) ^ (raw[starts[:live] + k] & 63)
    back = np.empty_like(hashes)
    back[order] = hashes
    return "".join(ALPHABET[h] for h in back.tolist())


def piecewise_hash(content: bytes) -> str:
    """blocksize:pieces:pieces of double size; empty content gives the hash of nothing."""
    raw = np.frombuffer(content, np.uint8)
    n = len(raw)
    block = SMALLEST
    while block * LENGTH < n:
        block *= 2
    while True:
        ends, double = _ends(raw, block), _ends(raw, 2 * block)
        if block > SMALLEST and len(ends) < LENGTH // 2:
            block //= 2
            continue
        break

    def signs(ends: np.ndarray, most: int) -> str:
        cut = ends[: most - 1]
        out = _pieces(raw, cut, most) if n else ""
        # what is left behind the last end has no sign where the rolling hash stands at nothing
        return out[:-1] if n and not rolling(raw[-WINDOW:])[-1] else out

    return f"{block}:{signs(ends, LENGTH)}:{signs(double, LENGTH // 2)}"


def _runs_cut(signs: str) -> str:
    """Runs of more than three equal signs say no more than three."""
    out = []
    for c in signs:
        if out[-3:] != [c, c, c]:
            out.append(c)
    return "".join(out)


def _distance(a: str, b: str) -> int:
    """Edits between two strings: insert and delete cost 1, replace 2."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (0 if x == y else 2))
    return row[-1]


def _likeness(a: str, b: str, block: int) -> int:
    if len(a) < WINDOW or len(b) < WINDOW:
        return 0
    parts = {a[i : i + WINDOW] for i in range(len(a) - WINDOW + 1)}
    if not any(b[i : i + WINDOW] in parts for i in range(len(b) - WINDOW + 1)):
        return 0
    score = 100 - 100 * (_distance(a, b) * LENGTH // (len(a) + len(b))) // LENGTH
    least = min(len(a), len(b))
    return score if block >= (99 + WINDOW) // WINDOW * SMALLEST else min(score, block // SMALLEST * least)


def likeness(one: str, other: str) -> int:
    """0 to 100; hashes of block sizes that are neither equal nor double do not compare."""
    (a, a1, a2), (b, b1, b2) = (x.split(":", 2) for x in (one, other))
    a, b = int(a), int(b)
    a1, a2, b1, b2 = map(_runs_cut, (a1, a2, b1, b2))
    if a == b:
        return 100 if (a1, a2) == (b1, b2) and len(a1) >= WINDOW else max(_likeness(a1, b1, a), _likeness(a2, b2, 2 * a))
    return _likeness(a1, b2, a) if a == 2 * b else _likeness(a2, b1, b) if b == 2 * a else 0
