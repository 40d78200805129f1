"""Hashed word shingles of whole texts, vectorised over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from mirrorfold.llm.common import held, texts_of

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
BASE = 0x9E3779B97F4A7C15 | 1
AT_ONCE = 1 << 20  # bytes of text; one longer text goes alone


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2**64."""
    if n > AT_ONCE + 1:  # one long word
        return _powers(n)
    up, down = held("shingles", lambda: _powers(AT_ONCE + 1))
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts that lie end to end, and each text's first word (with the end)."""
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate([inside[1:], [False]])
    first[bounds] = True
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, bounds)


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words; all its words as one if fewer; none without words."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") <= AT_ONCE):
            size += len(texts[end] or b"")
            end += 1
        some = [t or b"" for t in texts[at:end]]
        if size > AT_ONCE:  # one long text, hashed in pieces
            h = np.concatenate([_hashes([p])[0] for p in texts_of(some[0], AT_ONCE)])
            cuts = np.array([0, len(h)])
        else:
            h, cuts = _hashes(some)
        runs = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            runs = mixed(runs * np.uint64(3) + h[k : k + len(runs)])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            else:
                one = np.zeros(min(1, b - a), np.uint64)
                for x in h[a:b]:
                    one = mixed(one * np.uint64(3) + x)
                yield one
        at = end
