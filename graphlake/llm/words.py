"""Words and word shingles as 64-bit numbers, computed over whole blocks of texts with numpy.

A word is a maximal run of letters, marks and digits of the lower-cased text. Hashes depend on nothing but the
text, so all workers agree.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

SEED = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIER = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _word_chars() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i))[0] in "LMN" for i in range(0x110000)), np.bool_, 0x110000)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    n = 1 << bits
    up, down = np.full(n, _MULTIPLIER, np.uint64), np.full(n, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts in order, and where each text's words begin (one longer than texts)."""
    lower = [t.lower() for t in texts]
    cp = np.frombuffer(" ".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_word = np.zeros(len(cp) + 2, np.int8)
    is_word[1:-1] = _word_chars()[cp]
    edge = np.diff(is_word)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(max(20, int(len(cp)).bit_length()))
    sums = _sums((cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)])
    hashes = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * SEED)
    borders = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in lower], out=borders[1:])
    return hashes, np.searchsorted(begin, borders)


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of `width` words as (hash, text index), in order; a text of fewer words, but one at least, has one."""
    n, counts = len(words), np.diff(first)
    powers = _powers(20)[0]
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width if n >= width else 0):
        rolled += words[j : n - width + 1 + j] * powers[j + 1]
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = doc[: len(rolled)] == doc[width - 1 :] if len(rolled) else np.zeros(0, bool)
    out, owner = mix(rolled[inside]), doc[: len(rolled)][inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = np.array([int((words[first[i] : first[i + 1]] * powers[1 : counts[i] + 1]).sum(dtype=np.uint64)) for i in short], np.uint64)
        out, owner = np.concatenate([out, mix(own + counts[short].astype(np.uint64) * SEED)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def occurrences(gram: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-th occurrence of a shingle in its text as an element of its own: (elements, texts) in order of texts.

    So texts are plain sets, whose similarity is the weighted one of their shingles.
    """
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    unit = np.arange(len(gram)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return mix(gram + unit.astype(np.uint64) * SEED), owner
