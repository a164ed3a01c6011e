"""What the operators share: the shared folder, written intermediate tables and text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Code points handled at once inside a Python worker; bounds its memory (a longer text is a block of its own).
BLOCK_CHARS = 1 << 20
#: Rows and bytes that a worker gets at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: spark.checkpoint.dir, or a new local one where that is unset.

    On a cluster the setting must be there: nobody shares a folder of the driver's machine.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphlake-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Written intermediate tables of one operator call: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/graphlake-{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Only for tables that no frame still reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS, each: int = 1) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) ranges of at most `limit` code points, or of one text. Every text counts `each` more."""
    begin = size = 0
    for i, text in enumerate(texts):
        n = len(text or "") + each
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def merged(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Larger batches of at least `size` bytes each, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_CHARS, each: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their `text` column as strings; null is empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        texts = [x or "" for x in column.to_pylist()]
        for a, b in blocks(texts, limit, each):
            yield batch.slice(a, b - a), texts[a:b]
        give_back()


def free_name(docs: DataFrame, wanted: str) -> str:
    """A column name that docs does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def bounded(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at once, in rows and bytes, where the session's own bounds are wider."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    told = spark.conf.get(size, None) or ""
    if not told.removesuffix("b").isdigit() or int(told.removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def clean_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table holds."""
    bounded(docs.sparkSession)
    return docs.select("doc_id", "text")


def give_back() -> None:
    """Returns freed memory to the system, which allocators would keep for the worker's next task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Where a path of the shared folder leads, for Python workers: a local path, or a URI that pyarrow knows."""
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def write_whole(path: str, data: bytes) -> None:
    """The file appears under its name only when whole, so a repeated task replaces it."""
    system, name = file_system(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, name)


def read_whole(path: str) -> bytes:
    system, name = file_system(path)
    with system.open_input_stream(name) as file:
        return file.read()
