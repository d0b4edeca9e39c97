"""Vectorised hashing of words and windows in UTF-8 buffers: prefix polynomial hashes modulo 2^64, then a mix.

The hash of any byte range follows from two prefix values, so all words or all windows of a buffer come from a few
passes over it.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes that are hashed at a time; a longer document goes through in parts.
BUFFER = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i <= n."""
    size = max(BUFFER + 1024, 1 << int(n + 1).bit_length()) if n > BUFFER + 1000 else BUFFER + 1024
    if size not in _powers:
        made = []
        for base in (BASE, INVERSE):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        _powers.clear()
        _powers[size] = (made[0], made[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H[i]: hash of data[:i], a uint8 array; the hash of data[a:b] is (H[b] - H[a]) * BASE^-a."""
    out = np.zeros(len(data) + 1, np.uint64)
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)]
    np.cumsum(terms, out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def separators(kept: bytes | None = None) -> np.ndarray:
    """By byte: is it between words? Without kept: ASCII white space is; else all ASCII but kept."""
    table = np.zeros(256, bool)
    if kept is None:
        table[[9, 10, 11, 12, 13, 32]] = True
    else:
        table[:128] = True
        table[list(kept)] = False
    return table


def _parts(data: bytes, between: np.ndarray):
    """Parts of data of some BUFFER bytes that cut no word."""
    at = 0
    while len(data) - at > BUFFER:
        end = at + BUFFER
        cut = np.flatnonzero(between[np.frombuffer(data, np.uint8, BUFFER, at)])
        if len(cut):
            end = at + int(cut[-1]) + 1
        else:
            later = between[np.frombuffer(data, np.uint8, offset=end)]
            end = end + int(np.argmax(later)) if later.any() else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def _hashed(data: bytes, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a buffer."""
    chars = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(chars) + 2, np.int8)
    inside[1:-1] = ~between[chars]
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return mix(range_hashes(prefix_hashes(chars), start, end) + (end - start).astype(np.uint64)), start


def word_hashes(texts: list[bytes], between: np.ndarray):
    """For each text in turn, the hashes of its words. Short texts are hashed together."""
    held: list[bytes] = []
    size = 0

    def flush():
        if not held:
            return
        hashes, starts = _hashed(b" ".join(held), between)
        offsets = np.cumsum([0, *(len(t) + 1 for t in held)])
        cuts = np.searchsorted(starts, offsets)
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield hashes[a:b]
        held.clear()

    for text in texts:
        if size + len(text) > BUFFER:
            yield from flush()
            size = 0
        if len(text) > BUFFER:
            yield np.concatenate([_hashed(p, between)[0] for p in _parts(text, between)])
        else:
            held.append(text)
            size += len(text) + 1
    yield from flush()


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = out * BASE + words[i : i + n]
    return mix(out)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle; no words, none."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(windows(words, min(k, len(words))))
