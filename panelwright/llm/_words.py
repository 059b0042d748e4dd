"""Words and shingles of many texts at once, as 64-bit hashes computed over the texts' bytes with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from panelwright.llm._store import text_bytes

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NUMBER = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)

#: Bytes of words that white space parts: all but space and 0x09 to 0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of alphanumeric words after lower-casing: digits, a to z and all of 0x80 and above.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: The same without digits.
LETTERS = ALNUM.copy()
LETTERS[0x30:0x3A] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose output bits all depend on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """The words of some texts in order: byte spans in ``data``, hashes, and each text's first word (one entry more than texts)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _runs(texts: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, ...]:
    """The lower-cased bytes of all texts, which of them lie in words, the words' starts and ends, and the texts' offsets."""
    raw, offsets = text_bytes(texts)
    data = _LOWER[raw]
    flag = inside[data]
    size = len(data)
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:], after[:-1] = flag[:-1], flag[1:]
    cut = offsets[(offsets > 0) & (offsets < size)]
    before[cut], after[cut - 1] = False, False
    return data, flag, np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1, offsets


def terms(texts: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as one array of strings, and each text's first word in it (one entry more than texts)."""
    data, flag, start, end, offsets = _runs(texts, inside)
    return strings(end - start, data[flag]), np.searchsorted(start, offsets)


def strings(lengths: np.ndarray, data: np.ndarray | bytes) -> pa.Array:
    """UTF-8 strings that lie end to end in ``data``."""
    edges = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=edges[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(edges), pa.py_buffer(data))


def hashes(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes; strings are not empty. About a megabyte at a time, as the powers take eight bytes each."""
    data, edges = text_bytes(texts)
    out = np.zeros(len(texts), np.uint64)
    row = 0
    while row < len(out):
        stop = max(row + 1, int(np.searchsorted(edges, edges[row] + (1 << 20), "right")) - 1)
        part, cut = data[edges[row] : edges[stop]], edges[row : stop + 1] - edges[row]
        power, inverse = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_NUMBER[part] * power[: len(part)], out=sums[1:])
        out[row:stop] = mix((sums[cut[1:]] - sums[cut[:-1]]) * inverse[cut[:-1]])
        row = stop
    return out


def words(texts: pa.Array, inside: np.ndarray) -> Words:
    """Lower-case A-Z and cut texts into maximal runs of the bytes that ``inside`` marks; a null text has no words."""
    data, _, start, end, offsets = _runs(texts, inside)
    size = len(data)
    power, inverse = powers(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_NUMBER[data] * power[:size], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inverse[start])
    return Words(data, start, end, hashes, np.searchsorted(start, offsets), offsets)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, and the index of each run's first word."""
    if len(w.hash) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(w.hash) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + w.hash[i : i + n]
    owner = w.owner
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return mix(out[at]), at


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles; of fewer words the whole sequence; none without words."""
    hashes, at = windows(w, k)
    counts = w.counts
    edges = np.searchsorted(at, w.first)
    sets = []
    for d, n in enumerate(counts):
        if n >= k:
            s = np.sort(hashes[edges[d] : edges[d + 1]])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            sets.append(s[keep])
        elif n:
            x = int(n)
            for h in w.hash[w.first[d] : w.first[d + 1]].tolist():
                x = (x * _BASE + h) & 0xFFFFFFFFFFFFFFFF
            sets.append(mix(np.array([x], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
