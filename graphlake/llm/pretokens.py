"""Splitting blocks of texts into repeated units, and encoding each distinct unit once.

`byte_level_starts` follows the pre-tokenizer pattern of byte-level BPE vocabularies,
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+, as run boundaries over whole blocks.
Characters whose category has changed since Unicode 3.2 may be classed otherwise by a library's own tables; texts
with them, and texts with special strings, are left to the library (`risky`).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER, BORDER, UNSURE = range(6)
#: Ends each text in a block; no text with it takes this path.
MARK = "\U0010ffff"


@cache
def _classes() -> np.ndarray:
    old, out = unicodedata.ucd_3_2_0, np.full(0x110000, UNSURE, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind != old.category(c) or kind == "Cn":
            continue
        out[i] = {"L": LETTER, "N": NUMBER, "Z": SPACE}.get(kind[0], OTHER)
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x200B, 0x180E]] = UNSURE
    out[ord(MARK)] = BORDER
    return out


def risky(text: str, special: tuple[str, ...] = ()) -> bool:
    if any(s in text for s in special):
        return True
    if text.isascii():
        return any(c in text for c in "\x1c\x1d\x1e\x1f")
    classes = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return bool((classes >= BORDER).any())


def byte_level_starts(cp: np.ndarray) -> np.ndarray:
    """For each code point of a block whose texts end with MARK: does a unit begin here?"""
    kind = _classes()[cp]
    before = np.concatenate(([BORDER], kind[:-1]))
    last = np.concatenate(([0], cp[:-1]))
    start = (kind != before) & (last != 32)
    start |= kind == BORDER
    start |= before == BORDER
    space = kind == SPACE
    start &= ~space | (before != SPACE)
    start |= space & (before != SPACE)
    after = np.concatenate((kind[1:], [BORDER]))
    start |= space & (after != SPACE) & (after != BORDER)
    quotes = np.flatnonzero((cp == 39) & start & (last != 32))
    quotes = quotes[quotes + 2 < len(cp)]
    if len(quotes):
        one, two = cp[quotes + 1], cp[quotes + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for mask, n in ((single, 1), (double, 2)):
            at = quotes[mask]
            start[at + 1] = False
            end = at + 1 + n
            end = end[end < len(cp)]
            start[end[kind[end] == LETTER]] = True
    return start


def word_starts(cp: np.ndarray) -> np.ndarray:
    """A unit is a run of spaces with what follows up to the next space."""
    space, border = cp == 32, cp == ord(MARK)
    before = np.concatenate(([True], border[:-1]))
    return border | before | (space & ~np.concatenate(([False], space[:-1])))


def units(texts: list[str], starts: Callable[[np.ndarray], np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct units of a block, the unit number at each place in order, and where each text's places begin."""
    joined = MARK.join([*texts, ""])
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(starts(cp))
    border = cp[at] == ord(MARK)
    data = joined.encode("utf-8", "surrogatepass")
    if len(data) == len(cp):
        offsets = np.append(at, len(cp)).astype(np.int64)
    else:
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        total = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(width, out=total[1:])
        offsets = total[np.append(at, len(cp))]
    coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.flatnonzero(border)
    first = np.concatenate(([0], ends - np.arange(len(ends))))
    return coded.dictionary, codes[~border], first


class Encoder:
    """Ids of blocks of texts through a bounded memory of encoded units.

    encode_units: ids of each of some units; encode_text: ids of a text that must not be split into units.
    """

    def __init__(self, starts, encode_units, encode_text=None, is_risky=lambda text: False, limit: int = 300_000) -> None:
        self.starts, self.encode_units, self.encode_text, self.is_risky, self.limit = starts, encode_units, encode_text, is_risky, limit
        #: The units met of late, and those met before them; what is met again stays.
        self.memory: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) in order, and the number of ids of each text."""
        odd = [i for i, t in enumerate(texts) if self.is_risky(t)]
        plain = texts if not odd else [t for i, t in enumerate(texts) if i not in set(odd)]
        ids, counts = self._plain(plain)
        if not odd:
            return ids, counts
        parts, at, own = [], np.concatenate(([0], np.cumsum(counts))), iter(range(len(plain)))
        special = dict(zip(odd, self.encode_text([texts[i] for i in odd])))
        for i in range(len(texts)):
            if i in special:
                parts.append(np.asarray(special[i], np.uint32))
            else:
                k = next(own)
                parts.append(ids[at[k] : at[k + 1]])
        return np.concatenate(parts) if parts else ids, np.array([len(p) for p in parts], np.int64)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        distinct, codes, first = units(texts, self.starts)
        keys = distinct.to_pylist()
        memory = self.memory
        values = [memory.get(k) for k in keys]
        missing = []
        for i, v in enumerate(values):
            if v is None:
                if (v := self.older.get(keys[i])) is None:
                    missing.append(i)
                else:
                    values[i] = memory[keys[i]] = v
        for a in range(0, len(missing), 20_000):
            part = missing[a : a + 20_000]
            for i, v in zip(part, self.encode_units([keys[i] for i in part])):
                values[i] = v
                if len(keys[i]) <= 64:
                    memory[keys[i]] = v
        if len(memory) > self.limit:
            self.memory, self.older = {}, memory
        flat = np.frombuffer(b"".join(values), np.uint32)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        where = np.cumsum(sizes) - sizes
        per = sizes[codes]
        total = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(per, out=total[1:])
        index = np.repeat(where[codes] - total[:-1], per) + np.arange(total[-1])
        return flat[index], total[first[1:]] - total[first[:-1]]
