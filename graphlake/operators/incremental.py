"""Change detection, snapshot deltas and generations."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError


def classify_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """rel_path, status: new, changed, unchanged or deleted, by time and size. Both: rel_path (once), mtime_ns, size."""
    a = stored.select(F.col("rel_path").alias("_path"), F.col("mtime_ns").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_old"))
    b = current.select("rel_path", "mtime_ns", "size", F.lit(True).alias("_new"))
    same = F.col("_m").eqNullSafe(F.col("mtime_ns")) & F.col("_s").eqNullSafe(F.col("size"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return a.join(b, F.col("_path").eqNullSafe(F.col("rel_path")), "full").select(F.coalesce("rel_path", "_path").alias("rel_path"), status.alias("status"))


def snapshot_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The keys with op: insert, update or delete. One full outer join on the keys; null keys meet null keys.

    Rows are compared by a digest in which every null has a place, so a value that moves to another column is seen.
    """
    from .dml import row_digest

    rest = [c for c in old.columns if c not in keys]

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select(*(F.col(k).alias(f"{mark}{i}") for i, k in enumerate(keys)), row_digest(df, rest).alias(f"{mark}_row"), F.lit(True).alias(f"{mark}_there"))

    on = reduce(lambda x, y: x & y, (F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i in range(len(keys))))
    op = F.when(F.col("a_there").isNull(), "insert").when(F.col("b_there").isNull(), "delete").when(F.col("a_row") != F.col("b_row"), "update")
    both = side(old, "a").join(side(new, "b"), on, "full")
    return both.select(*(F.when(F.col("a_there"), F.col(f"a{i}")).otherwise(F.col(f"b{i}")).alias(k) for i, k in enumerate(keys)), op.alias("op")).filter("op is not null")


def edge_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with op: insert or delete, as multisets."""
    return new.exceptAll(old).withColumn("op", F.lit("insert")).unionByName(old.exceptAll(new).withColumn("op", F.lit("delete")))


def apply_delta(old: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """delta: the columns of old and op. Null keys are keys like others."""
    gone = delta.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)))
    kept = old.join(gone, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys))), "left_anti")
    return kept.unionByName(delta.filter("op <> 'delete'").select(*old.columns))


class StaleGeneration(RuntimeError):
    """Another generation was published meanwhile."""


class Generations:
    """Snapshots in numbered folders. A publication says which generation it follows; a reader pins one.

    Every publication writes a draft of its own. It is published by one rename that fails where the generation is there
    already, so of two publishers one succeeds; the rename is atomic where the file system's is. A draft that is not
    published is deleted.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        path, fs = self._fs()
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max([int(n[2:]) for n in names if n.startswith("g=") and n[2:].isdigit()], default=0)

    def publish(self, tables: dict[str, DataFrame], expected: int) -> int:
        if self.latest() != expected:
            raise StaleGeneration(f"generation {self.latest()} is there, not {expected}")
        draft = self.draft(tables)
        self.commit(draft, expected + 1)
        return expected + 1

    def draft(self, tables: dict[str, DataFrame]) -> str:
        """Writes the tables where no reader looks; returns the folder."""
        draft = f"{self.root}/.draft-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{draft}/{name}")
        return draft

    def commit(self, draft: str, number: int) -> None:
        """Publishes a draft as a generation, or raises StaleGeneration and deletes it."""
        hadoop, (_, fs) = self.spark._jvm.org.apache.hadoop.fs, self._fs()
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)  # none: nothing is replaced
        context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(hadoop.Path(draft), hadoop.Path(f"{self.root}/g={number}"), options)
        except (Py4JJavaError, PySparkException) as e:
            fs.delete(hadoop.Path(draft), True)
            if "FileAlreadyExists" not in str(e) and "already exists" not in str(e) and "not empty" not in str(e):
                raise
            raise StaleGeneration(f"generation {number} appeared meanwhile") from e

    def read(self, name: str, generation: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/g={generation or self.latest()}/{name}")

    def check(self, generation: int) -> None:
        """Raises StaleGeneration if what was read is no longer the latest: for a scan that must not mix generations."""
        if self.latest() != generation:
            raise StaleGeneration(f"generation {self.latest()} is there, not {generation}")


#: Edge types that indexing makes anew; others that lead into changed files are kept over it.
RECOMPUTED = ("SIMILAR_TO", "SEMANTICALLY_RELATED", "FILE_CHANGES_WITH", "CONFIGURES", "TESTS", "TESTS_FILE", "DATA_FLOWS")


def rescue_inbound(old_nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges from unchanged files into changed ones, led to the new nodes of the same qualified name.

    Where a name is gone, the edge follows to the only new node of its name and label in the changed files, if there
    is just one. changed: file_path.
    """
    hit = old_nodes.join(changed, "file_path", "left_semi").select(F.col("id").alias("target_id"), "qualified_name", "name", "label")
    inbound = edges.filter(~F.col("type").isin(*RECOMPUTED)).join(hit, "target_id").join(old_nodes.join(changed, "file_path", "left_anti").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    fresh = new_nodes.join(changed, "file_path", "left_semi")
    by_name = fresh.select("qualified_name", F.col("id").alias("_same"))
    alone = fresh.groupBy("name", "label").agg(F.count("*").alias("_n"), F.min("id").alias("_moved")).filter("_n = 1").drop("_n")
    led = inbound.join(by_name, "qualified_name", "left").join(alone, ["name", "label"], "left").withColumn("target_id", F.coalesce("_same", "_moved"))
    return led.filter("target_id is not null").select(*edges.columns)


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Do the digests of two tables agree? Then what was derived from the one still holds."""
    from .dml import multiset_digest

    return multiset_digest(a).head() == multiset_digest(b.select(*a.columns)).head()
