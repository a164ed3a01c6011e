"""Benchmark decontamination with SimHash windows.

A window has as many words as a benchmark item. The n-th occurrence of a five-word shingle in a window or an item is an
element of its own, so their weighted similarity is that of two sets. Fingerprints of windows and items are compared
block by block (multi-index hashing): of two fingerprints within the radius a certain number of blocks must nearly
agree, and a table for each block tells which items nearly agree with each value of it. The exact similarity then decides.

Only windows are hashed that could be similar to some item: most of their shingles must be of items of their size. A text
of fewer words than an item is one window against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bounded, clean_texts, give_back, text_blocks
from .words import SEED, mix, occurrences, shingles, word_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Two sets of as many elements and similarity 0.8 differ in 15 % of all bits, 39 of 256; RADIUS is 5 standard deviations above.
BITS, RADIUS = 256, 68
#: Blocks of 8 bits. Of fingerprints within RADIUS at most RADIUS // (NEAR + 1) blocks differ in more than NEAR bits.
BLOCKS, NEAR = 32, 2
AGREEING = BLOCKS - RADIUS // (NEAR + 1)
#: Items are taken to the executors in parts of at most so many words or items, one pass over the documents each: 16 MB of
#: shingles and 20 MB of block tables.
PART_WORDS, PART_ITEMS = 2_000_000, 20_000
#: Code points searched at once; shingles whose bits are summed at once; windows x words of the tables compared at once.
BLOCK, SUMMED, COMPARED = 1 << 19, 1 << 13, 1 << 18


def _bits(elements: np.ndarray) -> np.ndarray:
    """The 256 hash bits of each element."""
    words = mix(elements[:, None] + np.arange(1, BITS // 64 + 1, dtype=np.uint64) * SEED)
    return np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(elements), BITS // 8), axis=1)


def fingerprints(sums: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """32 bytes of majority bits from sums of the bits of n elements each."""
    return np.packbits(2 * sums > n, axis=-1)


def fingerprint(grams: np.ndarray) -> np.ndarray:
    """Of the elements of one window or item."""
    elements, _ = occurrences(grams, np.zeros(len(grams), np.int64))
    return fingerprints(_bits(elements).sum(axis=0, dtype=np.int64), len(elements))


def least_shared(a: int, b: int) -> int:
    """So many elements must two similar sets of a and b elements share."""
    return int(np.ceil(SIMILARITY * (a + b) / (1 + SIMILARITY) - 1e-9))


@dataclass(frozen=True)
class Hit:
    text: int
    item: int
    start: int
    words: int
    distance: int
    similarity: float


class Index:
    """The items of one part, in order of shingle width (5, or less for shorter items) and word count."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        words, first = word_hashes([t for _, t in items])
        sizes = np.diff(first)
        order = [int(i) for i in np.lexsort((sizes, np.minimum(sizes, WIDTH))) if sizes[i]]
        self.names = [items[i][0] for i in order]
        self.sizes = sizes[order]
        self.widths = np.minimum(self.sizes, WIDTH)
        self.grams = []
        for i, width in zip(order, self.widths):
            own = words[first[i] : first[i + 1]]
            self.grams.append(shingles(own, np.array([0, len(own)]), int(width))[0])
        self.prints = np.stack([fingerprint(g) for g in self.grams]) if order else np.zeros((0, BITS // 8), np.uint8)

    @cached_property
    def elements(self) -> list[np.ndarray]:
        return [np.sort(occurrences(g, np.zeros(len(g), np.int64))[0]) for g in self.grams]

    @cached_property
    def by_width(self) -> dict[int, tuple[int, int, np.ndarray, np.ndarray, dict[int, np.ndarray]]]:
        """For each shingle width: from which item to which, all their shingles, a filter of hashes, and the shingles of the items of each size."""
        out = {}
        for width in np.unique(self.widths):
            a, b = np.searchsorted(self.widths, [width, width + 1])
            gram = np.unique(np.concatenate(self.grams[a:b]))
            seen = np.zeros(1 << 22, bool)
            seen[gram & np.uint64((1 << 22) - 1)] = True
            sizes = self.sizes[a:b] - width + 1
            ends = {int(n): np.searchsorted(sizes, [n, n + 1]) + a for n in np.unique(sizes)}
            out[int(width)] = int(a), int(b), gram, seen, {n: np.unique(np.concatenate(self.grams[x:y])) for n, (x, y) in ends.items()}
        return out

    @cached_property
    def tables(self) -> np.ndarray:
        """For each block and each of its 256 values: a bit for every item whose block differs from it in NEAR bits at most."""
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= NEAR
        n = len(self.prints)
        out = np.zeros((BLOCKS, 256, -(-n // 64) * 8), np.uint8)
        for b in range(BLOCKS):
            bits = np.packbits(near[:, self.prints[:, b]], axis=1, bitorder="little")
            out[b, :, : bits.shape[1]] = bits
        return out.view(np.uint64)

    def candidates(self, prints: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) where enough blocks nearly agree, among the items from low to high."""
        a, b = low // 64, -(-high // 64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, COMPARED // (b - a))
        for s in range(0, len(prints), step):
            part = prints[s : s + step]
            planes = [np.zeros((len(part), b - a), np.uint64) for _ in range(BLOCKS.bit_length())]
            for block in range(BLOCKS):  # adds one bit to each item's count, which lies across the planes
                carry = self.tables[block, part[:, block], a:b]
                for k, plane in enumerate(planes):
                    planes[k], carry = plane ^ carry, plane & carry
            enough, equal = np.zeros_like(planes[0]), np.full_like(planes[0], np.iinfo(np.uint64).max)
            for k in reversed(range(len(planes))):
                if AGREEING >> k & 1:
                    equal &= planes[k]
                else:
                    enough |= equal & planes[k]
                    equal &= ~planes[k]
            bits = np.unpackbits((enough | equal).view(np.uint8), axis=1, bitorder="little")[:, low - a * 64 : high - a * 64]
            window, item = np.nonzero(bits)
            found.append((window + s, item + low))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def search(self, texts: list[str]) -> list[Hit]:
        """The best window of each similar item in each text."""
        words, first = word_hashes(texts)
        best: dict[tuple[int, int], Hit] = {}
        for width, (low, high, gram, seen, of_size) in self.by_width.items():
            own, owner = _all_windows(words, first, width)
            maybe = np.flatnonzero(seen[own & np.uint64((1 << 22) - 1)])
            marked = maybe[_among(own[maybe], gram)]
            if not len(marked):
                continue
            starts = np.searchsorted(owner, np.arange(len(texts) + 1))
            sizes = self.sizes[low:high] - width + 1
            found = own[marked]
            for n, wanted in of_size.items():
                if len(marked) < least_shared(n, n):
                    continue
                at = _dense(marked[_among(found, wanted)], owner, starts, n, least_shared(n, n))
                if len(at):
                    a, b = np.searchsorted(sizes, [n, n + 1])
                    self._verify(own, owner, starts, at, n, width, low + int(a), low + int(b), best)
            # whole texts of fewer shingles than an item
            has, held = np.diff(starts), np.bincount(owner[marked], minlength=len(texts))
            for t in np.flatnonzero((has > 0) & (held * (1 + SIMILARITY) >= SIMILARITY * (2 * has + 1) - 1e-9)).tolist():
                n = int(has[t])
                most = min(n / SIMILARITY, held[t] * (1 + SIMILARITY) / SIMILARITY - n) + 1e-9
                a, b = np.searchsorted(sizes, [n + 1, int(most) + 1])
                if a < b:
                    self._verify(own, owner, starts, starts[t : t + 1], n, width, low + int(a), low + int(b), best)
        return list(best.values())

    def _verify(self, own: np.ndarray, owner: np.ndarray, starts: np.ndarray, at: np.ndarray, n: int, width: int, low: int, high: int, best: dict) -> None:
        """Windows of n shingles at the given places against the items from low to high."""
        for part, prints in _prints(own, at, n):
            window, item = self.candidates(prints, low, high)
            distance = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1, dtype=np.int64)
            near = distance <= RADIUS
            before, elements = -1, None
            for w, i, d in zip(window[near].tolist(), item[near].tolist(), distance[near].tolist()):
                if w != before:
                    before, elements = w, occurrences(own[part[w] : part[w] + n], np.zeros(n, np.int64))[0]
                other = self.elements[i]
                both = int(_among(elements, other).sum())
                similarity = both / (n + len(other) - both)
                if similarity < SIMILARITY:
                    continue
                text = int(owner[part[w]])
                begin = int(part[w] - starts[text])
                old = best.get((text, i))
                if old is None or (-similarity, begin) < (-old.similarity, old.start):
                    best[text, i] = Hit(text, i, begin, n + width - 1, d, similarity)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array?"""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _dense(marked: np.ndarray, owner: np.ndarray, starts: np.ndarray, n: int, least: int) -> np.ndarray:
    """Where windows of n shingles begin that hold `least` marked ones. owner: the text of each shingle."""
    if len(marked) < least:
        return np.zeros(0, np.int64)
    a, b = marked[: len(marked) - least + 1], marked[least - 1 :]
    near = np.flatnonzero((b - a < n) & (owner[a] == owner[b]))
    a, b, text = a[near], b[near], owner[a[near]]
    begin, end = np.maximum(b - n + 1, starts[text]), np.minimum(a, starts[text + 1] - n)
    begin, end = begin[begin <= end], end[begin <= end]
    if not len(begin):
        return np.zeros(0, np.int64)
    begin[1:] = np.maximum(begin[1:], end[:-1] + 1)  # ranges go up; each place once
    size = np.maximum(end - begin + 1, 0)
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _prints(own: np.ndarray, at: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints of the windows of n shingles that begin at the given places, some at a time."""
    fresh = np.minimum(np.diff(at, prepend=at[0] - n), n)  # shingles that a window adds to those of the window before
    total = np.cumsum(fresh)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(total, total[i] + max(SUMMED - n, 1), "right")))
        part, step = at[i:j], fresh[i:j].copy()
        step[0] = n
        begin = np.cumsum(step) - n  # of each window among the shingles below
        place = np.repeat(part + n - step, step) + np.arange(step.sum()) - np.repeat(np.cumsum(step) - step, step)
        grams = own[place]
        sums = np.zeros((len(grams) + 1, BITS), np.int32)
        np.cumsum(_bits(mix(grams)), axis=0, out=sums[1:])
        prints = fingerprints(sums[begin + n] - sums[begin], n)
        order = np.argsort(grams, kind="stable")
        before = np.full(len(grams), -1)
        same = grams[order[1:]] == grams[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        for w in np.flatnonzero(np.maximum.accumulate(before)[begin + n - 1] >= begin):  # a shingle occurs again
            prints[w] = fingerprint(grams[begin[w] : begin[w] + n])
        yield part, prints
        i = j


def _all_windows(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of exactly `width` words; shorter texts have none."""
    sizes = np.diff(first)
    if (sizes >= width).all():
        return shingles(words, first, width)
    keep = sizes >= width
    own, owner = shingles(words[np.repeat(keep, sizes)], np.concatenate(([0], np.cumsum(sizes[keep]))), width)
    return own, np.flatnonzero(keep)[owner]


def parts(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of bounded size over all items, in order of item_id."""
    items: list[tuple[int, str]] = []
    words = 0
    for row in benchmark.select("item_id", "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        n = row.text.count(" ") + 1
        if items and (words + n > PART_WORDS or len(items) >= PART_ITEMS):
            yield Index(items)
            items, words = [], 0
        items.append((row.item_id, row.text))
        words += n
    if items:
        yield Index(items)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance, similarity: the best window of each similar item in each row.

    Reads doc_id and text, item_id and text, whatever other columns there are. Null texts and texts without words match
    nothing; texts of any length are searched whole; of equal items each is reported; of equally similar windows the first
    counts; repeated rows give repeated results. A document of fewer words than an item is one window, of n_words words.
    Empty tables give no rows.
    """
    out = None
    for index in parts(benchmark):
        taken = spark.sparkContext.broadcast(index)

        def run(batches, taken=taken):
            index = taken.value
            for batch, texts in text_blocks(batches, BLOCK):
                hits = sorted(index.search(texts), key=lambda h: (h.text, h.item))
                names = batch.column(batch.schema.get_field_index("doc_id"))
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array([h.text for h in hits], pa.int64())),
                        pa.array([index.names[h.item] for h in hits], pa.int64()),
                        pa.array([h.start for h in hits], pa.int64()),
                        pa.array([h.words for h in hits], pa.int64()),
                        pa.array([h.distance for h in hits], pa.int32()),
                        pa.array([h.similarity for h in hits], pa.float64()),
                    ],
                    ["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"],
                )

        found = clean_texts(docs).mapInArrow(run, "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, distance int, similarity double")
        out = found if out is None else out.unionByName(found)
    empty = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, distance int, similarity double"
    return spark.createDataFrame([], empty) if out is None else out


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item was found, with all their columns as they are; null texts stay."""
    bounded(spark)
    for index in parts(benchmark):
        docs = docs.filter(_is_clean(spark.sparkContext.broadcast(index))("text"))
    return docs


def _is_clean(taken):
    @F.arrow_udf("boolean")
    def is_clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = [x or "" for x in column.to_pylist()]
            clean = np.ones(len(texts), bool)
            for a, b in blocks(texts, BLOCK):
                clean[[a + h.text for h in taken.value.search(texts[a:b])]] = False
            yield pa.array(clean)
            give_back()

    return is_clean
