"""64-bit hashes of words and word runs, a batch of texts at a time.

A word is a run of bytes other than space and 9 to 13 in UTF-8, which for whole texts is the same as the
characters ``[^\\x20\\x09-\\x0D]+``. Hashes are for finding candidates and for comparing sets within a pair or a
bucket; two different words or runs share one with a probability of about 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (32, 9, 10, 11, 12, 13)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Words longer than this are hashed one by one.
LONG_WORD = 2048
_BASE, _SECOND = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of some texts end to end.

    ``data``: the texts' bytes; ``starts``, ``ends``: each word's place there; ``hashes``: each word's hash;
    ``bounds``: the first word of each text, one more at the end.
    """

    def __init__(self, texts: pa.Array, lower: bool):
        raw = pc.fill_null(texts, "").cast(pa.binary()).to_pylist()
        self.data = b" ".join(raw) + b" " * 9
        given = np.frombuffer(self.data, dtype=np.uint8)
        space = _IS_SPACE[given]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        first = np.cumsum([0, *(len(x) + 1 for x in raw)])
        self.bounds = np.searchsorted(self.starts, first)
        self.hashes = self._hashes(np.ascontiguousarray(_LOWER[given]) if lower else given)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        length = self.ends - self.starts
        h = mixed((eight[self.starts] & _MASKS[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(_BASE))
        at, k = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
        while len(at):
            left = length[at] - k
            h[at] = mixed(h[at] * np.uint64(_SECOND) ^ (eight[self.starts[at] + k] & _MASKS[np.minimum(left, 8)]))
            at, k = at[left > 8], k + 8
        if (long := np.flatnonzero(length > LONG_WORD)).size:
            import xxhash

            for i in long:
                h[i] = xxhash.xxh3_64_intdigest(data[self.starts[i] : self.ends[i]].tobytes())
        return h

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, b in enumerate((_BASE, inverse)):
            factors = np.full(size, b, dtype=np.uint64)
            factors[0] = 1
            _powers[k : k + 1] = [np.cumprod(factors)]
    return _powers[0], _powers[1]


class Runs:
    """Hashes of word runs in constant time each."""

    def __init__(self, hashes: np.ndarray, salt: int = 0):
        up, self.down = _power_tables(len(hashes) + 1)
        words = mixed(hashes ^ np.uint64(salt)) if salt else hashes
        self.sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(words * up[: len(hashes)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        run = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(run + (end - start).astype(np.uint64) * np.uint64(_SECOND))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of ``k`` words, sorted: all hashes end to end, and the bounds of each text.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    count = np.diff(words.bounds)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    edges = np.concatenate([[0], np.cumsum(n)])
    start = np.arange(edges[-1]) + np.repeat(words.bounds[:-1] - edges[:-1], n)
    end = np.minimum(start + k, np.repeat(words.bounds[1:], n))
    hashes = Runs(words.hashes)(start, end)
    sets = [np.unique(hashes[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), bounds
