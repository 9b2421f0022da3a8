"""Sets of hashed word shingles, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes that are hashed at once; a longer text goes piece by piece, whole words each.
PIECE = 1 << 18
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(2**62, 2**63)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WEIGHTS = _RNG.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BLANKS = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + 1024)
            self.up = np.full(size, _BASE, np.uint64)
            self.down = np.full(size, _INVERSE, np.uint64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of raw, letters A-Z lowered; words are what blanks separate."""
    data = np.frombuffer(raw, np.uint8)
    word = np.empty(len(data) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(_BLANK[data], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts


def _words(text: bytes) -> np.ndarray:
    """Word hashes of one long text, piece by piece."""
    found, at = [], 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and text[end] not in _BLANKS:
            end += 1
        found.append(word_hashes(text[at:end])[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of one text's words; of fewer words than a shingle has, one for all of them."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        return mix((words * _WEIGHTS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = words[: n - width + 1] * _WEIGHTS[0]
    for k in range(1, width):
        total = total + words[k : n - width + 1 + k] * _WEIGHTS[k]
    return mix(total)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of up to WIDTH words, in order."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        if group and size + len(t) > PIECE:
            yield from _group(group, width)
            group, size = [], 0
        if len(t) > PIECE:
            yield np.unique(_shingles(_words(t), width))
        else:
            group.append(t)
            size += len(t) + 1
    yield from _group(group, width)


def _group(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    if not texts:
        return
    hashes, starts = word_hashes(b" ".join(texts))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    for a, b in zip(bounds, bounds[1:]):
        yield np.unique(_shingles(hashes[a:b], width))
