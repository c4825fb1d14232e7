"""Word-shingle sets of texts as sorted arrays of 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A text's set holds its
distinct k-word shingles; a text of fewer words has its whole sequence as the one
member; a text without words has none.  All work is on the bytes of a block of
texts at once: a byte is mapped to a fixed random number, a word's hash is the
difference of two running sums of these numbers times powers of an odd factor,
and a shingle mixes its words' hashes by place.
"""

from __future__ import annotations

import numpy as np

BLOCK_BYTES = 500_000

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240117)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]                       # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        size = max(n, 2 * len(have))
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block(texts: list[bytes], k: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    n = len(data)
    space = _SPACE[data]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _FACTOR, n), out=sums[1:])
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]          # the block ends in a space
    word = mix((sums[ends] - sums[starts]) * _power("down", _INVERSE, n)[starts])
    limits = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(starts, limits - np.array([len(t) + 1 for t in texts]))
    last = np.searchsorted(starts, limits)
    if len(word) >= k:
        gram = np.zeros(len(word) - k + 1, dtype=np.uint64)
        for j in range(k):
            gram = mix(gram + word[j:len(word) - k + 1 + j] * np.uint64(2 * j + 3))
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= k:
            out.append(np.unique(gram[a:b - k + 1].view(np.int64)))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    whole = mix(np.array([whole * np.uint64(5) + w], dtype=np.uint64))[0]
            out.append(np.array([whole], dtype=np.uint64).view(np.int64))
        else:
            out.append(np.empty(0, dtype=np.int64))
    return out


def shingle_sets(texts, k: int):
    """Sorted distinct int64 hashes of each text's shingles (null: empty), in order."""
    block, size = [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        block.append(raw)
        size += len(raw)
        if size >= BLOCK_BYTES:
            yield from _block(block, k)
            block, size = [], 0
    if block:
        yield from _block(block, k)
