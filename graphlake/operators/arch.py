"""What a graph is made of: schema, packages, boundaries, layers, clusters and files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from .communities import leiden
from .derive import folder_chain

# -- schema


def _keys(df: DataFrame, by: str) -> DataFrame:
    names = F.array_sort(F.collect_set("key")).alias("keys")
    return df.select(by, F.explode(F.json_object_keys("properties")).alias("key")).distinct().groupBy(by).agg(names)


def _with_keys(df: DataFrame, by: str) -> DataFrame:
    counts = df.groupBy(by).agg(F.count("*").alias("count"))
    return counts.join(_keys(df, by), by, "left").select(by, "count", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


def label_schema(nodes: DataFrame) -> DataFrame:
    return _with_keys(nodes, "label")


def type_schema(edges: DataFrame) -> DataFrame:
    return _with_keys(edges, "type")


def patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source_label, type, target_label, count."""
    labels = nodes.select("id", "label")
    own = edges.join(labels.select(F.col("id").alias("source_id"), F.col("label").alias("source_label")), "source_id")
    own = own.join(labels.select(F.col("id").alias("target_id"), F.col("label").alias("target_label")), "target_id")
    return own.groupBy("source_label", "type", "target_label").agg(F.count("*").alias("count"))


# -- aspects

# Languages by file extension.
LANGUAGES = {
    "go": "Go", "py": "Python", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "rs": "Rust", "java": "Java", "kt": "Kotlin", "scala": "Scala",
    "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "hpp": "C++", "cs": "C#", "rb": "Ruby", "php": "PHP", "swift": "Swift", "lua": "Lua", "sh": "Shell", "sql": "SQL", "html": "HTML", "css": "CSS",
    "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "md": "Markdown", "tf": "Terraform", "zig": "Zig", "ex": "Elixir", "erl": "Erlang", "hs": "Haskell", "ml": "OCaml", "r": "R", "pl": "Perl",
}


def language(path):
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def languages(nodes: DataFrame) -> DataFrame:
    own = nodes.filter("label = 'File'").select(language(F.col("file_path")).alias("language")).filter("language is not null")
    return own.groupBy("language").agg(F.count("*").alias("file_count"))


def _packaged(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", scalar.package(F.col("qualified_name")).alias("package"))


def _calls(nodes: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """One row a package pair: calls are summed by package before anything else, so the work is linear in the edges."""
    own = _packaged(nodes)
    calls = edges.filter(F.col("type").isin(types)).select("source_id", "target_id")
    calls = calls.join(own.select(F.col("id").alias("source_id"), F.col("package").alias("from")), "source_id").join(own.select(F.col("id").alias("target_id"), F.col("package").alias("to")), "target_id")
    return calls.groupBy("from", "to").agg(F.count("*").alias("calls"))


def boundaries(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """from, to, calls between different packages."""
    return _calls(nodes, edges, types or ["CALLS"]).filter("`from` <> `to` and `from` <> '' and `to` <> ''")


def packages(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """name, node_count, fan_in, fan_out over other packages."""
    counts = _packaged(nodes).filter("package <> ''").groupBy(F.col("package").alias("name")).agg(F.count("*").alias("node_count"))
    across = boundaries(nodes, edges, types)
    fan_in = across.groupBy(F.col("to").alias("name")).agg(F.sum("calls").alias("fan_in"))
    fan_out = across.groupBy(F.col("from").alias("name")).agg(F.sum("calls").alias("fan_out"))
    return counts.join(fan_in, "name", "left").join(fan_out, "name", "left").na.fill(0, ["fan_in", "fan_out"])


def _true(name: str):
    return F.coalesce(F.get_json_object("properties", f"$.{name}") == "true", F.lit(False))


def entry_points(nodes: DataFrame) -> DataFrame:
    return nodes.filter(_true("is_entry_point") & ~scalar.is_test_file(F.col("file_path"))).select("id", "name", "qualified_name", "file_path")


def route_table(nodes: DataFrame) -> DataFrame:
    """method, path, handler of Route nodes."""
    json = [F.get_json_object("properties", f"$.{k}").alias(k) for k in ("method", "path", "handler")]
    return nodes.filter("label = 'Route'").select(*json)


def hotspots(nodes: DataFrame, edges: DataFrame, k: int = 10, types: list[str] | None = None) -> DataFrame:
    """The nodes that most edges lead to; tests are not meant."""
    fan = edges.filter(F.col("type").isin(types or ["CALLS"])).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in"))
    own = nodes.filter(~F.coalesce(scalar.is_test_file(F.col("file_path")), F.lit(False))).join(fan, "id")
    return own.select("id", "name", "qualified_name", "fan_in").orderBy(F.desc("fan_in"), "qualified_name", "id").limit(k)


def services(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """from, to, type, count of calls that cross services, by top package."""
    own = nodes.select("id", scalar.top_package(F.col("qualified_name")).alias("service"))
    calls = edges.filter(F.col("type").isin("HTTP_CALLS", "ASYNC_CALLS", "GRPC_CALLS", "GRAPHQL_CALLS", "TRPC_CALLS"))
    calls = calls.join(own.select(F.col("id").alias("source_id"), F.col("service").alias("from")), "source_id").join(own.select(F.col("id").alias("target_id"), F.col("service").alias("to")), "target_id")
    return calls.groupBy("from", "to", "type").agg(F.count("*").alias("count"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """package, layer, reason: routes make an api, entry points an entry; then what is only called, and what only calls."""
    own = nodes.withColumn("package", scalar.package(F.col("qualified_name"))).filter("package <> ''")
    handled = edges.filter("type = 'HANDLES'").select(F.col("source_id").alias("id")).distinct().withColumn("_handles", F.lit(True))
    json = F.get_json_object("properties", "$.route_path").isNotNull() | (F.col("label") == "Route")
    flags = own.join(handled, "id", "left").groupBy("package").agg(F.bool_or(json | F.coalesce("_handles", F.lit(False))).alias("routes"), F.bool_or(_true("is_entry_point")).alias("entry"))
    fans = packages(nodes, edges).select(F.col("name").alias("package"), "fan_in", "fan_out")
    layer = F.when(F.col("routes"), "api").when(F.col("entry"), "entry").when((F.col("fan_in") > 0) & (F.col("fan_out") == 0), "core").when((F.col("fan_in") == 0) & (F.col("fan_out") > 0), "leaf").otherwise("internal")
    reason = F.when(layer == "api", "has routes").when(layer == "entry", "has entry points").otherwise(F.concat(F.lit("fan-in "), F.col("fan_in"), F.lit(", fan-out "), F.col("fan_out")))
    return flags.join(fans, "package", "left").na.fill(0, ["fan_in", "fan_out"]).select("package", layer.alias("layer"), reason.alias("reason"))


def clusters(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, top: int = 5) -> DataFrame:
    """community, members, cohesion, top_nodes, packages, edge_types of communities of two nodes or more."""
    calls = edges.filter(F.col("type").isin(types or ["CALLS"])).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "type")
    member = leiden(nodes, calls)
    ends = calls.join(member.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(member.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    touching = ends.select(F.explode(F.array_distinct(F.array("ca", "cb"))).alias("community"), (F.col("ca") == F.col("cb")).alias("inside"), "type")
    of_edges = touching.groupBy("community").agg(F.try_divide(F.count(F.when(F.col("inside"), 1)), F.count("*")).alias("cohesion"), F.array_sort(F.collect_set(F.when(F.col("inside"), F.col("type")))).alias("edge_types"))
    named = member.join(nodes.select("id", "name", scalar.package(F.col("qualified_name")).alias("package")), "id")
    fan = calls.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("fan_in"))
    ranked = named.join(fan, "id", "left").withColumn("_rank", F.row_number().over(Window.partitionBy("community").orderBy(F.desc_nulls_last("fan_in"), "name", "id")))
    of_nodes = ranked.groupBy("community").agg(
        F.count("*").alias("members"), F.array_sort(F.collect_list(F.when(F.col("_rank") <= top, F.struct("_rank", "name")))).alias("_top"), F.array_sort(F.collect_set("package")).alias("packages")
    )
    return of_nodes.filter("members >= 2").join(of_edges, "community", "left").select("community", "members", "cohesion", F.transform("_top", lambda t: t["name"]).alias("top_nodes"), "packages", "edge_types")


def file_tree(files: DataFrame) -> DataFrame:
    """path, kind, children."""
    chain = folder_chain(files)
    counts = chain.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("children"))
    return chain.select(F.col("child").alias("path"), "kind").distinct().join(counts, "path", "left").na.fill(0, ["children"])


def docs_lookup(nodes: DataFrame) -> DataFrame:
    """Files that describe the architecture."""
    return nodes.filter(F.col("label") == "File").filter(F.lower("file_path").rlike(r"(^|/)(architecture|adr|design|readme)[^/]*\.(md|rst|txt|adoc)$|(^|/)adrs?/")).select("id", "file_path")


def linked_projects(edges: DataFrame) -> DataFrame:
    target = F.get_json_object("properties", "$.target_project")
    return edges.filter(F.col("type").startswith("CROSS_")).select(target.alias("project")).filter("project is not null").distinct()


ASPECTS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "languages": lambda n, e: languages(n),
    "packages": packages,
    "entry_points": lambda n, e: entry_points(n),
    "routes": lambda n, e: route_table(n),
    "hotspots": hotspots,
    "boundaries": boundaries,
    "services": services,
    "layers": layers,
    "clusters": clusters,
    "file_tree": lambda n, e: file_tree(n.filter("label = 'File'")),
}


def architecture(nodes: DataFrame, edges: DataFrame, aspects: list[str] | None = None, path: str = "") -> dict[str, DataFrame]:
    """The asked aspects, each lazy: `all`, `overview` (all but the file tree), or names; within a folder if path says one."""
    wanted = aspects or ["overview"]
    names = list(ASPECTS) if "all" in wanted else [a for a in ASPECTS if a != "file_tree"] if "overview" in wanted else wanted
    folder = path.strip("/")
    if folder:
        nodes = nodes.filter((F.col("file_path") == folder) | F.col("file_path").startswith(folder + "/"))
        ids = nodes.select("id")
        edges = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return {name: ASPECTS[name](nodes, edges) for name in names}
