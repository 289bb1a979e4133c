"""Array-at-a-time word hashing over Arrow string columns (used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Random 64-bit value of each byte, and the polynomial's base (odd, 5 mod 8) with its inverse.
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: Odd multipliers of the words of a shingle, first to last.
_PLACE = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) * U(2) + U(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (every output bit depends on every input bit)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 18)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Words:
    """Words of a run of texts: hash, text number and byte range of each; ``bounds`` cuts by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~_BLANK[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        prev = np.r_[False, solid[:-1]] if n else solid
        self.starts = np.flatnonzero(solid & (~prev | cut[:n]))
        nxt = np.r_[solid[1:], False] if n else solid
        self.ends = np.flatnonzero(solid & (~nxt | cut[1:])) + 1
        up, down = _powers(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[:n], dtype=np.uint64, out=run[1:])
        h = (run[self.ends] - run[self.starts]) * down[self.starts]
        self.hashes = mix(h + (self.ends - self.starts).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)


def text_runs(column: pa.Array, lower: bool, chunk: int = 1 << 18) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) over runs of whole texts of about ``chunk`` bytes; null texts are empty."""
    col = column.cast(pa.large_string()).fill_null("")
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + chunk, "right")) - 1)
        end = min(end, n)
        part = data[offs[at]: offs[end]]
        yield at, end, Words(_LOWER[part] if lower else part, offs[at: end + 1] - offs[at])
        at = end


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, sorted, and the bounds of each text's set.
    A text of 1 to k-1 words has its whole sequence as its one shingle; no words: an empty set."""
    h, counts, bounds = words.hashes, words.counts, words.bounds
    n = len(h)
    sets: list[np.ndarray] = []
    if n >= k:
        full = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            full += h[j: n - k + 1 + j] * _PLACE[j]
        full = mix(full)
    for i, c in enumerate(counts):
        a = bounds[i]
        if c >= k:
            s = full[a: a + c - k + 1].copy()
            s.sort()
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            sets.append(s[keep])
        elif c:
            sets.append(mix((h[a: a + c] * _PLACE[:c]).sum(dtype=np.uint64, keepdims=True) + U(int(c)) * _PLACE[-1]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)
