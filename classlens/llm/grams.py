"""Rolling hashes of word sequences, vectorised over a batch of texts.

Words are the maximal runs outside ``\\x20\\x09-\\x0D``, which is what ``bytes.split()`` cuts at. All words of a
batch stand one after the other; ``doc_of`` style boundaries keep windows inside their document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_RANDOM = np.random.RandomState(20240229)
_TABLES = [_RANDOM.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
#: Words hashed at a time, so that byte-wise arrays stay small whatever the length of a text.
CHUNK_WORDS = 1 << 17
#: A longer word enters the hashes by its digest.
LONG_WORD = 256
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get((base, 0))
    if known is None or len(known) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            known = _powers[(base, 0)] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def as_bytes(column) -> list[bytes | None]:
    """The UTF-8 bytes of a string column of an Arrow table or batch."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


class Words:
    """The words of a batch of texts. ``first[d] .. first[d + 1]`` are those of text d."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        split = [(t.lower() if lower else t).split() if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.n = int(self.first[-1])
        flat = [_short(x) for x in split if x]
        self.buffer = b" ".join(flat) + b" " if flat else b""
        ends = np.flatnonzero(np.frombuffer(self.buffer, np.uint8) == 32) + 1
        self.cuts = np.concatenate([[0], ends])
        assert len(ends) == self.n

    def within(self, k: int) -> np.ndarray:
        """Whether the k words that start at each word lie in one document."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(self.n) + k <= last

    def place(self) -> np.ndarray:
        """Each word's number in its document."""
        return np.arange(self.n) - np.repeat(self.first[:-1], np.diff(self.first))

    def hashes(self, k: int, which: int = 0) -> np.ndarray:
        """64-bit hash of the k words from each word on, of fewer at the end of its text."""
        out = np.empty(self.n, np.uint64)
        base, table = _BASES[which], _TABLES[which]
        inverse = pow(base, -1, 1 << 64)
        data = np.frombuffer(self.buffer, np.uint8)
        last = np.repeat(self.first[1:], np.diff(self.first))
        with np.errstate(over="ignore"):
            for a in range(0, self.n, CHUNK_WORDS):
                b = min(a + CHUNK_WORDS, self.n)
                upto = np.minimum(np.arange(a, b) + k, last[a:b])
                low, high = self.cuts[a], self.cuts[upto.max()]
                part = table[data[low:high]] * _power(base, high - low)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
                start, end = self.cuts[a:b] - low, self.cuts[upto] - low
                out[a:b] = mix((sums[end] - sums[start]) * _power(inverse, high - low)[start])
        return out


def _short(words: list[bytes]) -> bytes:
    if max(map(len, words)) > LONG_WORD:
        words = [w if len(w) <= LONG_WORD else b"\0" + hashlib.blake2b(w).digest().hex().encode() for w in words]
    return b" ".join(words)


def in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values
