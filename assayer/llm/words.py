"""Words of many texts at once: byte arrays, word bounds and 64-bit word hashes, without a Python object per word.

A word is a maximal run of bytes other than space and 0x09-0x0D."""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Spans over so many bytes are hashed one by one, by a cryptographic hash.
LONG = 64
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of values[start:end]: eight bytes after eight go through ``mix``; long spans are hashed by BLAKE2b.
    Hashes may collide: who needs exact results compares what was hashed."""
    width = values.itemsize
    raw = np.frombuffer(values.tobytes() + b"\0" * 8, dtype=np.uint8)
    eight = np.ndarray((max(0, len(raw) - 7),), dtype="<u8", buffer=raw, strides=(1,))
    at, size = starts * width, (ends - starts) * width
    out = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64((seed * 0xA0761D6478BD642F + 0x51ED270B) % (1 << 64))
    out = mix((out ^ (eight[at] & _MASK[np.minimum(size, 8)])) * np.uint64(0x9E3779B97F4A7C15)) if len(at) else out
    more = np.flatnonzero((size > 8) & (size <= LONG))
    done = 8
    while len(more):
        left = size[more] - done
        out[more] = mix((out[more] ^ (eight[at[more] + done] & _MASK[np.minimum(left, 8)])) * np.uint64(0x9FB21C651E98DF25))
        done += 8
        more = more[left > 8]
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[at[i] : at[i] + size[i]], digest_size=8, key=key).digest(), "little")
    return out


class Words:
    """data: all texts with one space after each; start, end, hash: of each word; first: index of each text's first
    word, and the number of words at the end; bounds: each text's place in data."""

    def __init__(self, texts: list[bytes], lower: bool = False, seed: int = 0):
        self.data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        if lower:
            self.data = LOWER[self.data]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
        blank = SPACE[self.data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(self.data) and not blank[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = spans_hash(self.data, self.start, self.end, seed)
        self.first = np.searchsorted(self.start, self.bounds)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words numbered a and b are equal, byte by byte."""
        size = self.end - self.start
        out = size[a] == size[b]
        raw = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
        left, done = np.flatnonzero(out), 0
        while len(left) and done < LONG:
            x, y, rest = a[left], b[left], size[a[left]] - done
            equal = ((eight[self.start[x] + done] ^ eight[self.start[y] + done]) & _MASK[np.minimum(rest, 8)]) == 0
            out[left[~equal]] = False
            done += 8
            left = left[equal & (rest > 8)]
        for i in left.tolist():
            x, y = (self.data[self.start[w] : self.end[w]] for w in (a[i], b[i]))
            out[i] = bool((x == y).all())
        return out

    def window_words(self, k: int) -> np.ndarray:
        """The number of the first word of each window that ``windows`` gives."""
        n = max(0, len(self.hash) - k + 1)
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return np.flatnonzero(doc[:n] == doc[len(doc) - n :])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word windows inside texts, and the number of each window's text."""
        n = len(self.hash) - k + 1
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.hash[:n].copy()
        for j in range(1, k):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + self.hash[j : j + n])
        same = doc[:n] == doc[k - 1 :]
        return h[same], doc[:n][same]


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
