"""Texts of a slice as one byte array: words, lines and their hashes for all texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import spans_of

_RANDOM = np.random.default_rng(7)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: All bytes but ASCII letters, digits and those of other characters.
NO_WORD = np.ones(256, dtype=bool)
NO_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, held: dict = {}) -> np.ndarray:  # noqa: B006  one table for each worker
    if len(held.get("p", ())) < n:
        held["p"] = np.cumprod(np.full(max(64, 2 * n), _STEP, dtype=np.uint64))
    return held["p"]


def run_hashes(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each run values[start : start + size]; runs follow each other
    from starts[0] on, and zero values at a run's end do not count."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    base = starts[0]
    total = int(starts[-1] + sizes[-1] - base)
    place = np.arange(total, dtype=np.int32) - np.repeat((starts - base).astype(np.int32), sizes)
    return mix(np.add.reduceat(values[base : base + total] * powers(int(sizes.max()))[place], starts - base))


class Texts:
    """Word k of text i is word number words[i] + k."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = SPACE):
        self.raw, self.offsets, self.n = raw, offsets, len(offsets) - 1
        self.text = raw + (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5) if lower else raw
        space = breaks[raw]
        self.breaks = breaks
        before = np.ones(len(raw), dtype=bool)
        before[1:] = space[:-1]
        before[offsets[:-1][offsets[:-1] < len(raw)]] = True
        self.starts = np.flatnonzero(~space & before)
        after = np.ones(len(raw), dtype=bool)
        after[:-1] = space[1:]
        inner = offsets[1:][offsets[1:] > 0]
        after[inner - 1] = True
        self.ends = np.flatnonzero(~space & after) + 1
        #: number of the first word of each text (and the end)
        self.words = np.searchsorted(self.starts, offsets)
        self.space = space

    def word_hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        sizes = np.diff(self.starts, append=len(self.text))
        return run_hashes(np.where(self.breaks, np.uint64(0), _BYTE)[self.text], self.starts, sizes)

    def count(self, hit: np.ndarray) -> np.ndarray:
        """For each text, how many of its bytes are hit (a mask over all bytes)."""
        return np.diff(spans_of(hit)[self.offsets])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (without the line feed), text number and hash of all lines; a
        text is split at each line feed, an empty one is one empty line."""
        feed = np.flatnonzero(self.raw == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], feed + 1]))
        ends = np.sort(np.concatenate([self.offsets[1:], feed]))
        of = np.repeat(np.arange(self.n), np.diff(np.searchsorted(feed, self.offsets)) + 1)
        hashes = np.zeros(len(starts), dtype=np.uint64)
        full = np.flatnonzero(ends > starts)
        if len(full):
            values = _BYTE[self.raw]
            values[feed] = 0
            s = starts[full]
            hashes[full] = run_hashes(values, s, np.diff(s, append=len(self.raw)))
        return starts, ends, of, hashes


def slices(column: pa.Array, lower: bool = False, size: int = 2 << 20, breaks: np.ndarray = SPACE) -> Iterator[tuple[int, int, Texts]]:
    """First and last row, and texts, of slices of about so many bytes; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b, Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower, breaks)
        a = b


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), dtype=bool)
    eq = k[1:] == k[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    out = np.zeros(len(k), dtype=bool)
    out[order] = same
    return out
