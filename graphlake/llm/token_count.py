"""Token counts without ids: pieces are counted once for each distinct pre-token of the corpus, joined to the
pre-token frequencies of the documents, and summed.

Documents are dealt into blocks of bounded size. A block lists its distinct pre-tokens and how often each document has
them; the frequencies wait in the shared folder while the pre-tokens of all blocks meet by hash, where each distinct one
is counted once and the counts go back to the blocks. A block's pre-tokens and its frequencies always come from the same
run of its task, whatever runs again.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import Scratch, clean_texts, read_whole, text_blocks, write_whole
from .pretokens import MARK, byte_level_starts, risky, units

#: A block of documents ends when it has so many code points; a document is never split.
BLOCK = 16 << 20
#: A row has the pre-tokens of a block that fall into a bucket, or their counts on the way back to the block.
_ROWS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
_SQL = "block bigint, bucket int, data binary"
#: Buckets per shuffle partition.
SPREAD = 4


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


class _Block:
    """The frequencies of one block: (document, pre-token code, count) triples and the distinct pre-tokens."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.fixed: list[np.ndarray] = []
        self.triples: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_ids: list, texts: list[str], tokenizer, special) -> None:
        odd = [i for i, t in enumerate(texts) if MARK in t or risky(t, special)]
        fixed = np.zeros(len(texts), np.int64)
        plain = list(texts)
        for i, e in zip(odd, tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)):
            fixed[i], plain[i] = len(e), ""
        distinct, local, first = units(plain, byte_level_starts)
        table = self.codes
        known = np.array([table.setdefault(u, len(table)) for u in distinct.to_pylist()], np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(first)) + len(self.ids)
        key, count = np.unique(owner << 32 | known[local], return_counts=True)
        self.triples.append(np.stack([(key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), count.astype(np.int32)]))
        self.ids += doc_ids
        self.sizes.append(np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64))
        self.fixed.append(fixed)
        self.chars += sum(map(len, texts))

    def save(self, folder: str, place: int) -> int:
        """Writes documents and frequencies, codes as steps from the one before, compressed; returns the file's number.

        The number is a hash of the content and of the block's place, so that a task that runs again with its rows in
        another order writes other files, and never replaces one whose codes are in use.
        """
        doc, code, often = np.concatenate(self.triples, axis=1)
        names = pa.array(self.ids, pa.int64())
        known = np.array([x is not None for x in self.ids])
        docs = np.stack([names.fill_null(0).to_numpy(zero_copy_only=False), known, np.concatenate(self.sizes), np.concatenate(self.fixed), np.bincount(doc, minlength=len(known))]).astype(np.int64)
        data = np.array([len(known), len(doc)], np.int64).tobytes() + docs.tobytes() + np.diff(code, prepend=0).astype(np.int32).tobytes() + often.astype(np.int32).tobytes()
        number = int.from_bytes(hashlib.sha256(place.to_bytes(8, "little") + data + b"".join(self.codes)).digest()[:8], "little") >> 1
        write_whole(f"{folder}/{number}", len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True))
        return number

    @staticmethod
    def load(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc_id, known, bytes, fixed tokens) of the documents, and the triples' documents, codes and counts."""
        raw = read_whole(path)
        data = pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)
        n, m = np.frombuffer(data, np.int64, 2)
        docs = np.frombuffer(data, np.int64, 5 * n, 16).reshape(5, n)
        at = 16 + 40 * int(n)
        code = np.cumsum(np.frombuffer(data, np.int32, m, at))
        return docs[:4], np.repeat(np.arange(n), docs[4]), code, np.frombuffer(data, np.int32, m, at + 4 * int(m))

    def rows(self, number: int, buckets: int):
        """One row for each bucket with its pre-tokens: codes, sizes and bytes. A block without any has one empty row."""
        pieces = list(self.codes)
        bucket = np.fromiter(map(zlib.crc32, pieces), np.int64, len(pieces)) % buckets
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(part):
                own = [pieces[i] for i in part]
                data = np.array([len(part), *part, *map(len, own)], np.int32).tobytes() + b"".join(own)
                yield pa.RecordBatch.from_pydict({"block": [number], "bucket": [int(bucket[part[0]])], "data": [data]}, _ROWS)
        if not pieces:
            yield pa.RecordBatch.from_pydict({"block": [number], "bucket": [0], "data": [np.zeros(1, np.int32).tobytes()]}, _ROWS)


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, limit: int = 512, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    Reads doc_id and text, whatever other columns there are. Null and empty texts have no tokens; null and repeated
    doc_ids give a row each; a very long text is a block of its own; an empty table gives none. Special strings inside a
    text count as the library takes them.
    """
    scratch = Scratch(spark, "counts")
    folder = scratch.path("blocks")
    buckets = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def frequencies(batches):
        tokenizer, special = _tokenizer(tokenizer_path)
        task, made = TaskContext.get().partitionId(), 0
        now = _Block()

        def finish():
            yield from now.rows(now.save(folder, task << 32 | made), buckets)

        for batch, texts in text_blocks(batches):
            now.add(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), texts, tokenizer, special)
            if now.chars >= block:
                yield from finish()
                now, made = _Block(), made + 1
        if now.ids:
            yield from finish()

    # Written as a table: of tasks that run twice one is committed, and only what it says of its blocks counts from there on.
    rows = scratch.keep(clean_texts(docs).mapInArrow(frequencies, _SQL), "pieces")

    def count(group: pa.Table) -> pa.Table:
        """Counts the distinct pre-tokens of a bucket once; a row goes back to each block."""
        tokenizer, _ = _tokenizer(tokenizer_path)
        codes, sizes, texts = [], [], []
        for data in group.column("data").to_pylist():
            n = int(np.frombuffer(data, np.int32, 1)[0])
            codes.append(np.frombuffer(data, np.int32, n, 4))
            sizes.append(np.frombuffer(data, np.int32, n, 4 + 4 * n))
            texts.append(data[4 + 8 * n :])
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes), dtype=np.int64)))
        column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(texts))]).dictionary_encode()
        pieces = [p.decode("utf-8", "surrogatepass") for p in column.dictionary.to_pylist()]
        each = np.array([len(e) for a in range(0, len(pieces), 20_000) for e in tokenizer.encode_batch_fast(pieces[a : a + 20_000], add_special_tokens=False)], np.int32)
        per = np.split(each[column.indices.to_numpy()], np.cumsum([len(c) for c in codes])[:-1])
        back = [np.stack([c, n]).tobytes() for c, n in zip(codes, per)]
        return pa.table([group.column("block"), group.column("bucket"), pa.array(back, pa.binary())], schema=_ROWS)

    counted = rows.groupBy("bucket").applyInArrow(count, _SQL)

    def total(group: pa.Table) -> pa.Table:
        counts = np.concatenate([np.frombuffer(x, np.int32).reshape(2, -1) for x in group.column("data").to_pylist()], axis=1)
        size = np.zeros(counts.shape[1], np.int64)
        size[counts[0]] = counts[1]
        (names, known, sizes, fixed), doc, piece, often = _Block.load(f"{folder}/{group.column('block')[0].as_py()}")
        tokens = fixed + np.bincount(doc, often * size[piece], len(names)).astype(np.int64)
        return pa.table({"doc_id": pa.array(names, mask=known == 0), "n_bytes": sizes, "n_tokens": tokens, "over_limit": tokens > limit})

    return counted.groupBy("block").applyInArrow(total, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
