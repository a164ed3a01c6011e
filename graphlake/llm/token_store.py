"""Token ids in a binary file format with Elias-Fano document boundaries.

A file holds one range of documents in ascending doc_id order: the concatenated ids, then a footer with the document
boundaries and the doc_ids as Elias-Fano sequences, a JSON description and its length. Boundaries cost about
2 + log2(tokens per document) bits each; sampled positions of the upper bits answer select without a 64-bit table.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_CHARS, Scratch, clean_texts, file_system, merged, text_blocks
from .pretokens import MARK, Encoder, byte_level_starts, risky

MAGIC = b"GLTOKEN1"
END_ID = 2
#: One position is kept for every so many set upper bits.
SAMPLE = 64
_LISTED = pa.schema([("file", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])


class EliasFano:
    """A non-decreasing sequence of numbers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        lows = values & np.uint64((1 << low_bits) - 1)
        bits = (lows[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        upper[ones] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(upper, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample, count set bits byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, mask = at >> 3, 0xFF << (at & 7) & 0xFF
        while (ones := (int(self.high[byte]) & mask).bit_count()) <= left:
            left, byte, mask = left - ones, byte + 1, 0xFF
        word = int(self.high[byte]) & mask
        for _ in range(left):
            word &= word - 1
        position = byte * 8 + (word & -word).bit_length() - 1
        low = 0
        for j in range(self.low_bits):
            bit = i * self.low_bits + j
            low |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << j
        return (position - i) << self.low_bits | low

    def select_range(self, i: int, j: int) -> np.ndarray:
        """The i-th to (j - 1)-th values: from the sample before i to the sample behind j, whatever the sequence's length."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.int64)
        sample, behind = i // SAMPLE, -(-j // SAMPLE)
        begin = int(self.samples[sample]) >> 3
        end = (int(self.samples[behind]) >> 3) + 1 if behind < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + begin * 8
        ones = ones[ones >= int(self.samples[sample])][i - sample * SAMPLE : j - sample * SAMPLE]
        if not self.low_bits:
            return ones - np.arange(i, j)
        first, last = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[first >> 3 : (last + 7) >> 3], bitorder="little")[first & 7 :][: last - first].reshape(j - i, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1, dtype=np.int64)
        return ((ones - np.arange(i, j)) << self.low_bits) + low

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]

    @classmethod
    def load(cls, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> EliasFano:
        return cls(n, low_bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, np.uint32))


class Writer:
    """Streams one file; it appears under its name only when whole, so a repeated task replaces it."""

    def __init__(self, path: str, dtype: str) -> None:
        self.fs, self.path = file_system(path)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out, self.dtype, self.counts, self.ids = self.fs.open_output_stream(self.part), dtype, [], []
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.counts.append(len(ids) // np.dtype(self.dtype).itemsize)
        self.ids.append(doc_id)

    def close(self) -> tuple[int, int]:
        known = np.array([x for x in self.ids if x is not None], np.int64)
        base = int(known[0]) if len(known) else 0
        ends = EliasFano.build(np.concatenate(([0], np.cumsum(self.counts, dtype=np.int64))))
        names = EliasFano.build((known - base).astype(np.uint64))
        parts = ends.parts() + names.parts()
        for p in parts:
            self.out.write(p)
        about = {"dtype": self.dtype, "docs": len(self.ids), "tokens": int(sum(self.counts)), "nulls": len(self.ids) - len(known), "base": base, "low_bits": [ends.low_bits, names.low_bits], "sizes": [len(p) for p in parts]}
        text = json.dumps(about).encode()
        self.out.write(text + len(text).to_bytes(4, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)
        return about["docs"], about["tokens"]


class Reader:
    def __init__(self, path: str) -> None:
        system, name = file_system(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        n = int.from_bytes(tail[:4], "little")
        self.about = json.loads(self.file.read_at(n, size - 12 - n))
        at, parts = size - 12 - n - sum(self.about["sizes"]), []
        for s in self.about["sizes"]:
            parts.append(self.file.read_at(s, at))
            at += s
        docs, nulls = self.about["docs"], self.about["nulls"]
        self.width = np.dtype(self.about["dtype"]).itemsize
        self.ends = EliasFano.load(docs + 1, self.about["low_bits"][0], *parts[:3])
        self.names = EliasFano.load(docs - nulls, self.about["low_bits"][1], *parts[3:])

    def ids(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document."""
        a, b = self.ends.select(i), self.ends.select(i + 1)
        return np.frombuffer(self.file.read_at((b - a) * self.width, len(MAGIC) + a * self.width), self.about["dtype"])

    def find(self, doc_id: int) -> int:
        """The place of the first document with this id, by binary search over select; the number of documents if there is none."""
        nulls, base = self.about["nulls"], self.about["base"]
        low, high = 0, self.names.n
        while low < high:
            middle = (low + high) // 2
            if self.names.select(middle) + base < doc_id:
                low = middle + 1
            else:
                high = middle
        found = low < self.names.n and self.names.select(low) + base == doc_id
        return low + nulls if found else self.about["docs"]

    def documents(self, block: int = 1 << 22, docs: int = 4096) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first token, ids) of all documents; boundaries of `docs` documents are selected and some `block` tokens read at once."""
        nulls, n = self.about["nulls"], self.about["docs"]
        for a in range(0, n, docs):
            b = min(a + docs, n)
            ends = self.ends.select_range(a, b + 1)
            names = self.names.select_range(max(a - nulls, 0), max(b - nulls, 0)) + self.about["base"]
            names = [None] * (b - a - len(names)) + names.tolist()
            i = 0
            while i < b - a:
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + block, "right")) - 1)
                data = np.frombuffer(self.file.read_at(int(ends[j] - ends[i]) * self.width, len(MAGIC) + int(ends[i]) * self.width), self.about["dtype"])
                for k in range(i, j):
                    yield names[k], int(ends[k]), data[ends[k] - ends[i] : ends[k + 1] - ends[i]]
                i = j


@cache
def byte_level_encoder(path: str) -> Encoder:
    """Ids as the tokenizers library gives them for the file, each distinct pre-token encoded once by the library."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_units(units: list[bytes]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in encode([u.decode("utf-8", "surrogatepass") for u in units])]

    return Encoder(byte_level_starts, encode_units, encode, lambda text: MARK in text or risky(text, special))


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, folder: str, files: int | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes token files under folder and returns their list: file number, path, docs, tokens, first token.

    Reads doc_id and text. Null and empty texts have the end id alone; null doc_ids come first; repeated doc_ids all
    stay, in the order of their ids. An empty table has one file without documents or none. The list has a row for
    each file and is the only thing that reaches the driver.
    """
    rows = clean_texts(docs)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / files for i in range(1, files)] if files > 1 else [0.5], 100 * files).alias("c")).head()["c"] or []
    cuts = sorted(set(cuts)) if files > 1 else []
    part = F.lit(0) if not cuts else F.expr(f"size(filter(array({', '.join(f'{c}L' for c in cuts)}), c -> c < doc_id))")

    # two bytes an id where all ids of the vocabulary fit
    dtype = "<u2" if _vocabulary(tokenizer_path, end_id) <= 1 << 16 else "<u4"

    def encode(batches):
        encoder = byte_level_encoder(tokenizer_path)
        for batch, texts in text_blocks(merged(batches), 2 * BLOCK_CHARS):
            ids, counts = encoder(texts)
            ends = np.concatenate(([0], np.cumsum(counts + 1)))
            out = np.full(ends[-1], end_id, "<u4")
            keep = np.ones(ends[-1], bool)
            keep[ends[1:] - 1] = False
            out[keep] = ids
            out = out.astype(dtype)
            data = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((ends * out.itemsize).astype(np.int64)), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), data.cast(pa.binary())], ["doc_id", "ids"])

    coded = rows.mapInArrow(encode, "doc_id bigint, ids binary").withColumn("file", part)

    def write(batches):
        writer, number = None, 0
        for batch in batches:
            for doc_id, ids, file in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if writer is None:
                    number, writer = file, Writer(f"{folder}/{file:08d}.tok", dtype)
                writer.add(doc_id, ids)
        if writer is not None:
            n, tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"file": [number], "path": [f"{folder}/{number:08d}.tok"], "docs": [n], "tokens": [tokens]}, _LISTED)

    dealt = coded.repartitionById(len(cuts) + 1, F.coalesce(F.col("file"), F.lit(0)).cast("int")).sortWithinPartitions("doc_id", "ids")
    listed = sorted(dealt.mapInArrow(write, "file int, path string, docs bigint, tokens bigint").collect())
    first, rows_out = 0, []
    for r in listed:
        rows_out.append((r.file, r.path, r.docs, r.tokens, first))
        first += r.tokens
    return spark.createDataFrame(rows_out, "file int, path string, docs bigint, tokens bigint, first bigint")


@cache
def _vocabulary(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1)


def read_tokens(listed: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the listed files.

    Reads path and first, whatever other columns the list has. Repeated and null doc_ids give a row each; a document
    without text has its end id alone; a very long one is read at once, others in blocks. An empty list gives no rows.
    """

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for doc_id, at, ids in Reader(path).documents():
                    rows.append((doc_id, first + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    def _batch(rows):
        names = ("doc_id", "start", "n_tokens", "ids_crc32")
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=list(names))

    files = max(1, listed.count())
    return listed.select("path", "first").repartition(files).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def store_and_read(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return read_tokens(write_tokens(spark, docs, tokenizer_path, Scratch(spark, "tokens").path("files")))
