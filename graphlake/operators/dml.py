"""Scans, lookups and changes of node and edge tables; every change gives new tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType, TimestampType

from ..functions import scalar
from .lineage import cut

NODE_KEY = ["project", "qualified_name"]


# -- scans


def by_suffix(nodes: DataFrame, suffix: str) -> DataFrame:
    """The qualified name is the suffix, or ends with it behind a dot."""
    return nodes.filter((F.col("qualified_name") == suffix) | F.col("qualified_name").endswith("." + suffix))


def lookup(nodes: DataFrame, field: str, value: object, project: str | None = None) -> DataFrame:
    """Nodes whose id, name, qualified_name or file_path is the value, in one project or in any."""
    if field not in ("id", "name", "qualified_name", "file_path"):
        raise ValueError(f"nodes are not looked up by {field}")
    found = nodes.filter(F.col(field) == value)
    return found if project is None else found.filter(F.col("project") == project)


def list_files(nodes: DataFrame, project: str | None = None) -> DataFrame:
    """project, file_path: each once, in order."""
    own = nodes if project is None else nodes.filter(F.col("project") == project)
    return own.filter("file_path is not null and file_path <> ''").select("project", "file_path").distinct().orderBy("project", "file_path")


def list_projects(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, nodes, edges: how many each project has."""
    a = nodes.groupBy("project").agg(F.count("*").alias("nodes"))
    b = edges.groupBy("project").agg(F.count("*").alias("edges"))
    return a.join(b, "project", "full").na.fill(0, ["nodes", "edges"])


def counts(rows: DataFrame, by: str, path: str = "", nodes: DataFrame | None = None) -> DataFrame:
    """by, n: rows (nodes or edges) of each label, type or project; within a folder if path says one.

    Edges lie in a folder if both their ends do, for which `nodes` (id, file_path) is asked.
    """
    folder = path.strip("/")
    if folder:
        inside = (F.col("file_path") == folder) | F.col("file_path").startswith(folder + "/")
        if nodes is None:
            rows = rows.filter(inside)
        else:
            ids = nodes.filter(inside).select("id")
            for end in ("source_id", "target_id"):
                rows = rows.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def count_vectors(vectors: DataFrame, project: str | None = None) -> DataFrame:
    """One row: n vectors that are not null."""
    own = vectors if project is None else vectors.filter(F.col("project") == project)
    return own.agg(F.count("vector").alias("n"))


def register(spark, nodes: DataFrame, edges: DataFrame, prefix: str = "") -> None:
    """Makes the graph's tables known to SQL as nodes and edges, or with a prefix before these names."""
    nodes.createOrReplaceTempView(f"{prefix}nodes")
    edges.createOrReplaceTempView(f"{prefix}edges")


def overlapping(nodes: DataFrame, file_path: str, start: int, end: int) -> DataFrame:
    """Nodes of a file whose lines meet the range; modules and packages are not meant."""
    return nodes.filter((F.col("file_path") == file_path) & (F.col("start_line") <= end) & (F.col("end_line") >= start) & ~F.col("label").isin("Module", "Package"))


def ids_of(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """qualified_name, id of each asked name; 0 where there is none."""
    return names.join(nodes.select("qualified_name", "id"), "qualified_name", "left").select("qualified_name", F.coalesce("id", F.lit(0)).alias("id"))


def edges_by_url(edges: DataFrame, word: str) -> DataFrame:
    return edges.filter(F.get_json_object("properties", "$.url_path").contains(word))


def selectors(roots: DataFrame) -> DataFrame:
    """path, selector: the base name, or the shortest end of the path that no other path has. roots: path."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    ends = roots.withColumn("_p", parts).select("path", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_p"), F.lit(1)))).alias("k"), "_p")
    ends = ends.select("path", "k", F.array_join(F.slice("_p", F.size("_p") - F.col("k") + 1, F.col("k")), "/").alias("end"))
    alone = ends.withColumn("n", F.count("*").over(Window.partitionBy("k", "end")))
    return alone.groupBy("path").agg(F.coalesce(F.min_by(F.when(F.col("n") == 1, F.col("end")), F.when(F.col("n") == 1, F.col("k"))), F.first("path")).alias("selector"))


# -- changes


def upsert(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of new replace those of old with the same keys, null keys those with null keys. new may say in a column `seq` which of its rows is the latest."""
    keys = keys or NODE_KEY
    order: Column = F.col("seq") if "seq" in new.columns else F.lit(0)
    latest = new.withColumn("_seq", order)
    rest = [c for c in old.columns if c not in keys]
    latest = latest.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_seq", *rest)).alias("_row")).select(*keys, "_row.*")
    return without(old, latest, keys).unionByName(latest.select(*old.columns))


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not among those of gone; null keys meet null keys."""
    there = gone.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)))
    return rows.join(there, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys))), "left_anti")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each source, target, type and, for imports, local name; it keeps the smallest properties that say anything."""
    local = F.when(F.col("type") == "IMPORTS", F.coalesce(F.get_json_object("properties", "$.local_name"), F.lit(""))).otherwise("")
    smallest = F.coalesce(F.min(F.nullif("properties", F.lit("{}"))), F.lit("{}")).alias("properties")
    keyed = edges.withColumn("_local", local).groupBy("source_id", "target_id", "type", "_local")
    return keyed.agg(F.min("id").alias("id"), F.min("project").alias("project"), smallest).select(*edges.columns)


def merge_graphs(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds a graph: nodes with the same name keep their id and take the new fields; edges follow to it."""
    known = nodes.select(*NODE_KEY, F.col("id").alias("_old"))
    ids = more_nodes.join(known, NODE_KEY, "left").select(F.col("id").alias("_id"), F.coalesce("_old", "id").alias("_now"))
    renamed = more_nodes.join(ids, F.col("id") == F.col("_id")).withColumn("id", F.col("_now")).select(*nodes.columns)
    moved = more_edges
    for end in ("source_id", "target_id"):
        moved = moved.join(ids, F.col(end) == F.col("_id"), "left").withColumn(end, F.coalesce("_now", end)).select(*more_edges.columns)
    return upsert(nodes, renamed), merge_edges(edges.unionByName(moved))


def delete_nodes(nodes: DataFrame, edges: DataFrame, doomed: Column) -> tuple[DataFrame, DataFrame]:
    """Without the nodes for which the condition holds, nor any edge of theirs."""
    gone = nodes.filter(doomed).select("id")
    kept = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.filter(~F.coalesce(doomed, F.lit(False))), kept.select(*edges.columns)


def delete_empty_folders(nodes: DataFrame, edges: DataFrame, under: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Folders that contain nothing go, and then those that contained only them.

    under: file_path of changed files; then only folders on the way to one of them are looked at.
    """
    if under is not None:
        every = F.transform(F.sequence(F.lit(1), F.size(F.split("file_path", "/"))), lambda i: F.array_join(F.slice(F.split("file_path", "/"), F.lit(1), i), "/"))
        affected = cut(under.select(F.explode(every).alias("file_path")).distinct())
    while True:
        holders = edges.filter(F.col("type").isin("CONTAINS_FOLDER", "CONTAINS_FILE")).select(F.col("source_id").alias("id")).distinct()
        folders = nodes.filter("label = 'Folder'")
        folders = folders if under is None else folders.join(affected, "file_path", "left_semi")
        empty = cut(folders.join(holders, "id", "left_anti").select("id"))
        if empty.isEmpty():
            return nodes, edges
        nodes = cut(nodes.join(empty, "id", "left_anti").select(*nodes.columns))
        edges = cut(edges.join(empty.withColumnRenamed("id", "target_id"), "target_id", "left_anti").join(empty.withColumnRenamed("id", "source_id"), "source_id", "left_anti").select(*edges.columns))


def dense_ids(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids from 1 on in order of (project, qualified_name): ranks within ranges of names, after the sizes of the ranges before."""
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(nodes.repartitionByRange(n, *NODE_KEY).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # a row for each range
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*NODE_KEY, "id"))
    ranked = cut(dealt.withColumn("_rank", rank).join(F.broadcast(offsets), "_part").withColumn("_new", (F.col("_rank") + F.col("_before")).cast("bigint")))
    ids = ranked.select(F.col("id").alias("_old"), "_new")
    out = edges
    for end in ("source_id", "target_id"):
        out = out.join(ids, F.col(end) == F.col("_old")).withColumn(end, F.col("_new")).select(*edges.columns)
    return ranked.withColumn("id", F.col("_new")).select(*nodes.columns), out


def plausible(persisted: int, committed: int) -> bool:
    """Is what was written at least half of what was meant to be? Small graphs are not judged."""
    return not (committed > 50 and persisted < committed / 2)


# -- digests


def encoded(value: Column, kind: DataType) -> Column:
    """A text that no other value of the type has: its length and characters, ~ for null, parts of nested values in order."""
    if isinstance(kind, StructType):
        text = F.concat(*(encoded(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(""))
    elif isinstance(kind, ArrayType):
        text = F.array_join(F.transform(value, lambda x: encoded(x, kind.elementType)), "")
    elif isinstance(kind, MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.concat(encoded(e.getField("key"), kind.keyType), encoded(e.getField("value"), kind.valueType)))
        text = F.array_join(F.array_sort(pairs), "")
    elif isinstance(kind, BinaryType):
        text = F.hex(value)
    elif isinstance(kind, TimestampType):
        text = F.unix_micros(value).cast("string")
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "~").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns, or all of them in order, as one text that no other row has."""
    kinds = {f.name: f.dataType for f in df.schema}
    return F.concat(*(encoded(F.col(f"`{c}`"), kinds[c]) for c in (df.columns if columns is None else columns)), F.lit(""))


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of row_text, as 32 bytes."""
    return F.unhex(F.sha2(row_text(df, columns), 256))


def multiset_digest(df: DataFrame) -> DataFrame:
    """n, xor and sum: of the four 64-bit words of the rows' SHA-256 digests, the same for the same rows in any order.

    xor is a text of 64 hexadecimal digits, sum the four sums in decimals. A null has a place of its own in the digest.
    """
    text = F.sha2(row_text(df), 256)
    words = [F.conv(F.substr(text, F.lit(16 * i + 1), F.lit(16)), 16, 10).cast("decimal(20,0)") for i in range(4)]
    signed = [F.conv(F.substr(text, F.lit(16 * i + 1), F.lit(16)), 16, -10).cast("bigint") for i in range(4)]
    sums = df.select(*(w.alias(f"w{i}") for i, w in enumerate(words)), *(s.alias(f"s{i}") for i, s in enumerate(signed)))
    sums = sums.agg(F.count("*").alias("n"), *(F.coalesce(F.bit_xor(f"s{i}"), F.lit(0)).alias(f"x{i}") for i in range(4)), *(F.coalesce(F.sum(F.col(f"w{i}").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"t{i}") for i in range(4)))
    xor = F.concat(*(F.lpad(F.lower(F.hex(f"x{i}")), 16, "0") for i in range(4)))
    return sums.select("n", xor.alias("xor"), F.concat_ws(" ", *(F.col(f"t{i}").cast("string") for i in range(4))).alias("sum"))


def ordered_digest(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """One row: n, sha256 of all rows in order of the keys.

    Rows are dealt into ranges of the keys' digests; each range is hashed in order by itself, and the digests of the
    ranges in order make the whole one. So no task holds more than a range, and the digest depends on rows and `buckets` alone.
    """
    buckets = buckets or 64
    text = df.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), row_text(df).alias("_text"))
    place = F.conv(F.substr(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f"_k{i}").cast("string"), F.lit("~")) for i in range(len(keys)))), 256), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    dealt = text.withColumn("_bucket", F.pmod(place, F.lit(buckets))).withColumn("_row", F.sha2("_text", 256))
    each = dealt.groupBy("_bucket").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*(f"_k{i}" for i in range(len(keys))), "_row"))).alias("rows"))
    each = each.select("_bucket", "n", F.sha2(F.array_join(F.transform("rows", lambda r: r["_row"]), ""), 256).alias("own"))
    whole = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_sort(F.collect_list(F.struct("_bucket", "own"))).alias("all"))  # `buckets` digests
    return whole.select("n", F.sha2(F.array_join(F.transform("all", lambda r: r["own"]), ""), 256).alias("sha256"))


def grouped_topology(edges: DataFrame) -> DataFrame:
    """source_id, type, target_id, payloads: parallel edges as one group with their sorted properties."""
    return edges.groupBy("source_id", "type", "target_id").agg(F.array_sort(F.collect_list("properties")).alias("payloads"))


# -- project summaries

#: The sections of a summary, in order, and its longest text.
SECTIONS = ("PURPOSE", "STACK", "ARCHITECTURE", "PATTERNS", "TRADEOFFS", "PHILOSOPHY")
LONGEST = 8000


def summary_sections(text: Column) -> Column:
    """A map of the known `## SECTION` headings to their texts; an unknown heading stays in the section before it."""
    pieces = F.split(F.concat(F.lit("\n"), text), r"\n(?=## (?:" + "|".join(SECTIONS) + r")[ \t]*(?:\n|$))")
    own = F.filter(pieces, lambda p: p.rlike(r"^## (?:" + "|".join(SECTIONS) + r")[ \t]*(?:\n|$)"))
    pairs = F.transform(own, lambda p: F.struct(F.regexp_extract(p, r"^## (\w+)", 1).alias("key"), scalar.trim(F.regexp_replace(p, r"^## \w+[ \t]*\n?", "")).alias("value")))
    return F.map_from_entries(pairs)


def render_summary(sections: Column) -> Column:
    parts = [F.when(F.try_element_at(sections, F.lit(s)).isNotNull(), F.concat(F.lit(f"## {s}\n"), F.try_element_at(sections, F.lit(s)))) for s in SECTIONS]
    return F.concat_ws("\n\n", *parts)


def summary_put(summaries: DataFrame, new: DataFrame) -> DataFrame:
    """Adds or replaces projects' summaries (project, text). A text that is not valid raises."""
    bad = new.filter(~F.coalesce(summary_is_valid(F.col("text")), F.lit(False))).select("project").limit(1).collect()
    if bad:
        raise ValueError(f"the summary of {bad[0].project} has no known section or more than {LONGEST} characters")
    return upsert(summaries, new, ["project"])


def summary_section(summaries: DataFrame, project: str, section: str) -> DataFrame:
    """project, text of one section."""
    own = summaries.filter(F.col("project") == project)
    return own.select("project", F.try_element_at(summary_sections(F.col("text")), F.lit(section)).alias("text"))


def summary_delete(summaries: DataFrame, project: str) -> DataFrame:
    return summaries.filter(~F.col("project").eqNullSafe(F.lit(project)))


def summary_is_valid(text: Column) -> Column:
    return (F.length(text) <= LONGEST) & (F.size(summary_sections(text)) > 0)
