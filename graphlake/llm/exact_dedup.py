"""Exact deduplication with a keyed state on disk that never expires, in DataFrame expressions only.

A streaming aggregation keeps, for each digest of a normalised text, the smallest stable identifier, a content locator
(file and row) and the group's size in RocksDB. Rows whose digest was there before are hits; their full bytes are fetched
by the locators and compared, and where they differ the digest is not trusted.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_name

#: A state partition is for so many rows at least: each costs files of some megabytes however few keys it holds.
STATE_ROWS = 20_000
#: A list of up to so many locators (60 MB) is sent to all executors, a longer one is joined.
BROADCAST_ROWS = 100_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """Each run of spaces, tabs and line breaks becomes one space; a single space is left as it is."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"), F.lit(" "))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def keyed_state(spark: SparkSession, rows: DataFrame, at: str, partitions: int | None = None) -> DataFrame:
    """Runs the stream `rows` (digest, doc_id, locator) to its end and returns its state: digest, keep_id, locator, group_size.

    A later call with the same folder and more rows goes on from the state that is there.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "locator")).alias("first")
    told = rows.groupBy("digest").agg(first, F.count("*").alias("n"))
    settings = {"spark.sql.streaming.stateStore.providerClass": PROVIDER}
    if partitions:
        settings["spark.sql.streaming.internal.stateStore.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = told.writeStream.outputMode("update").format("noop").option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(at)
    first, n = (F.col(f"value.{name}") for name in state.schema["value"].dataType.names)
    return state.select("key.digest", first.doc_id.alias("keep_id"), first.locator.alias("locator"), n.alias("group_size"))


def located(spark: SparkSession, docs: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, str]:
    """docs with a column of their locators (file, row in the file), and its name.

    Rows that come from Parquet files have them; others are written to the shared folder first and read from there.
    """
    at = free_name(docs, "_at")

    def told(df: DataFrame) -> DataFrame:
        where = df.metadataColumn("_metadata")
        return df.withColumn(at, F.struct(where.getField("file_path").alias("file"), where.getField("row_index").alias("row")))

    try:
        return told(docs), at
    except AnalysisException:
        return told(scratch.keep(docs, name)), at


def fetched(rows: DataFrame, at: str, wanted: DataFrame) -> DataFrame:
    """The rows whose locators are in `wanted` (column at). A list of proven size goes to the executors, a longer one is joined."""
    wanted = wanted.select(F.col("at").alias("_wanted"))
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, F.col(at) == F.col("_wanted"), "left_semi")


def dedup(spark: SparkSession, docs: DataFrame, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, locator (of the row that stays) for each row of docs.

    Reads doc_id and text, whatever other columns there are. Null counts as empty, so all null and empty texts are one
    group; texts of any length are read whole. Of equal texts the row with the smallest doc_id is kept; null doc_ids come
    last, and of rows repeated with that doc_id the first by file and place is kept. An empty table gives no rows.
    """
    return _ruled(spark, docs, digest)[0].drop("at")


def _ruled(spark: SparkSession, docs: DataFrame, digest) -> tuple[DataFrame, DataFrame, str]:
    """What dedup returns with each row's own locator `at`; docs with locators, and the name of that column."""
    scratch = Scratch(spark, "exact")
    docs, at = located(spark, docs, scratch, "docs")
    normal = normalised(F.col("text"))
    own = [] if digest is sha256 else [sha256(normal).alias("sha")]
    hashed = scratch.keep(docs.select(digest(normal).alias("digest"), "doc_id", F.col(at).alias("at"), *own), "hashed")
    stream = spark.readStream.schema(hashed.schema).option("maxFilesPerTrigger", 10_000).parquet(scratch.path("hashed"))
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), hashed.count() // STATE_ROWS + 1)
    state = keyed_state(spark, stream.select("digest", "doc_id", F.col("at").alias("locator")), scratch.path("state"), partitions)
    rows = hashed.withColumn("sha", F.col("digest") if digest is sha256 else F.col("sha"))
    found = scratch.keep(rows.join(state, "digest"), "found")
    # Hits: the full bytes of all rows whose digest was met more than once, and of no others, are fetched by their
    # locators. The smallest and largest text of a digest are the same only if all are; copies shrink to one before the shuffle.
    hits = found.filter("group_size > 1")
    told = fetched(docs.select("doc_id", "text", at), at, hits.select("at"))
    told = told.select(digest(normal).alias("digest"), "doc_id", F.col(at).alias("at"), normal.alias("text"))
    mixed = scratch.keep(told.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select("digest"), "mixed")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "locator", "at"]
    out = found.withColumn("kept", F.col("at") == F.col("locator")).withColumn("text_sha256", F.lower(F.hex("sha")))
    if mixed.isEmpty():
        return out.select(*columns), docs, at
    # Some digest stands for several texts: its rows are grouped by their full texts instead.
    odd = scratch.keep(told.join(mixed, "digest", "left_semi"), "odd")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("first")
    odd = odd.join(odd.groupBy("text").agg(first, F.count("*").alias("group_size")), "text")
    odd = odd.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("first.at")).alias("kept"), F.sha2("text", 256).alias("text_sha256"), F.col("first.at").alias("locator"), "at")
    return out.join(mixed, "digest", "left_anti").select(*columns).unionByName(odd), docs, at


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, those named like a result's too; of rows that repeat doc_id and text, one."""
    names = docs.columns
    ruled, rows, at = _ruled(spark, docs, sha256)
    gone = Scratch(spark, "exact").keep(ruled.filter("not kept").select("at"), "gone")
    few = gone.count() <= BROADCAST_ROWS
    gone = gone.select(F.col("at").alias("_gone"))
    return rows.join(F.broadcast(gone) if few else gone, F.col(at) == F.col("_gone"), "left_anti").select(*(F.col(f"`{c}`") for c in names))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)"""
