"""Words of Arrow string columns as NumPy arrays, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII signs read as spaces.
PLAIN = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_STEP = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which each bit of the input moves all bits of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """start, end: byte ranges in `data` of all words; first: index of each text's first word (one more at the end)."""

    def __init__(self, texts: pa.Array, fold: np.ndarray | None = None):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        base, last = int(offsets[0]), int(offsets[-1])
        self.data = np.frombuffer(data, np.uint8)[base:last] if data is not None and last > base else np.zeros(0, np.uint8)
        if fold is not None:
            self.data = fold[self.data]
        self.offsets = offsets - base
        word = ~SPACE[self.data]
        cut = np.zeros(len(self.data) + 1, bool)
        cut[self.offsets] = True
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | cut[:-1]))
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits of each word's bytes."""
        n = len(self.start)
        out = np.empty(n, np.uint64)
        pow_ = powers(0x9E3779B97F4A7C15, int((self.end - self.start).max(initial=0)) or 1)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + _STEP)))
            a, b = int(self.start[at]), int(self.end[to - 1])
            s, e = self.start[at:to] - a, self.end[at:to] - a
            lens = e - s
            flat = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
            value = _BYTE[self.data[np.repeat(s, lens) + flat + a]]
            value *= pow_[flat]
            out[at:to] = np.add.reduceat(value, np.cumsum(lens) - lens) + lens.astype(np.uint64)
            at = to
        return mixed(out)

    def windows(self, hashes: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
        """Rabin-Karp hashes of k words from each word on, from prefix sums modulo 2**64; valid where k words follow in the text."""
        n = len(hashes)
        if n < k:
            return np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(base, n), out=total[1:])
        return mixed((total[k:] - total[:-k]) * powers(pow(base, -1, 2**64), n - k + 1))


def released() -> None:
    """Gives freed memory back to the system: workers live on between tasks and share an executor with its JVM."""
    import contextlib
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches, limit: int, column: str = "text"):
    """Record batches cut and joined so that the texts of each have about `limit` bytes at most (one text is never cut)."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        at, run = 0, np.cumsum(lens)
        while at < batch.num_rows:
            done = run[at - 1] if at else 0
            to = max(int(np.searchsorted(run, done + limit - size, "right")), at + (not held))
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(run[to - 1] - done)
                at = to
            if at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                released()
    if held:
        yield pa.Table.from_batches(held)
    released()
