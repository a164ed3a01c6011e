"""Edges derived from other edges and records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from .lineage import cut

# -- change coupling


def change_coupling(commits: DataFrame, most_files: int = 20, least: int = 3, threshold: float = 0.3) -> DataFrame:
    """file_a, file_b, co_changes, score, last_co_change. commits: commit, file, ts; a commit of many files says nothing.

    Commits are counted before their files are gathered, so the pairs of a commit are made from an array of at most
    `most_files` names and no other is.
    """
    each = commits.groupBy("commit", "file").agg(F.max("ts").alias("ts"))
    few = each.groupBy("commit").agg(F.count("file").alias("n"), F.max("ts").alias("last")).filter(F.col("n").between(1, most_files)).select("commit", F.col("last"))
    own = each.filter("file is not null").join(few, "commit").groupBy("commit", F.col("last").alias("ts")).agg(F.array_sort(F.collect_list("file")).alias("files"))
    counts = own.select(F.explode("files").alias("file")).groupBy("file").agg(F.count("*").alias("n"))
    first = own.select("ts", "files", F.posexplode("files").alias("i", "file_a"))
    pairs = first.select("ts", "file_a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("file_b"))
    both = pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("co_changes"), F.max("ts").alias("last_co_change")).filter(F.col("co_changes") >= least)
    for side in ("a", "b"):
        both = both.join(counts.select(F.col("file").alias(f"file_{side}"), F.col("n").alias(f"n_{side}")), f"file_{side}")
    score = F.col("co_changes") / F.least("n_a", "n_b")
    return both.withColumn("score", score).filter(F.col("score") >= threshold).select("file_a", "file_b", "co_changes", "score", "last_co_change")


# -- names

# Confidences of the ways to resolve a name.
CONFIDENCE = {"import_map": 0.95, "import_map_suffix": 0.85, "same_module": 0.90, "qualified_suffix": 0.90, "unique_name": 0.75, "suffix_match": 0.55}


def _last(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def _prefixes(name: Column) -> Column:
    """The name and what stands before each of its dots: a, a.b, a.b.c of a.b.c."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def _suffixes(name: Column) -> Column:
    """What stands behind each dot of the name: b.c, c of a.b.c."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))).otherwise(F.array().cast("array<string>"))


def resolve_names(calls: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """call_id, target_id, strategy, confidence: the best way for each call that some way resolves.

    calls: call_id, module, callee; nodes: id, qualified_name; imports: module, local_name, target (a qualified name).
    Every way is an equality join with the best candidate of each key, so no call meets all candidates of a common name,
    however many there are; ties go to the lesser qualified name.
    """
    calls = calls.withColumn("prefix", F.element_at(F.split("callee", r"\."), 1)).withColumn("suffix", F.regexp_replace("callee", r"^[^.]*\.?", "")).withColumn("last", _last(F.col("callee")))
    names = nodes.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("qn")).withColumn("last", _last(F.col("qn"))).withColumn("home", F.regexp_replace("qn", r"\.[^.]*$", ""))
    first = F.min(F.struct("qn", "target_id")).alias("best")
    mapped = calls.join(imports.withColumnRenamed("local_name", "prefix"), ["module", "prefix"])
    ways = []

    def way(df: DataFrame, name: str, confidence: Column | float | None = None) -> None:
        c = F.lit(CONFIDENCE[name]) if confidence is None else confidence
        ways.append(df.select("call_id", F.col("best.target_id").alias("target_id"), F.col("best.qn").alias("qn"), F.lit(name).alias("strategy"), c.cast("double").alias("confidence")))

    whole = names.groupBy(F.col("qn").alias("key")).agg(first)
    exact = mapped.withColumn("key", F.concat_ws(".", "target", F.when(F.col("suffix") != "", F.col("suffix")).otherwise(F.col("prefix"))))
    way(exact.join(whole, "key"), "import_map")
    ends = names.select("qn", "target_id", F.explode(_suffixes(F.col("qn"))).alias("key"))
    between = ends.select("qn", "target_id", "key", F.explode(_prefixes(F.regexp_replace("qn", r"\.[^.]*$", ""))).alias("target")).groupBy("target", "key").agg(first)
    way(mapped.filter("suffix <> ''").withColumn("key", F.col("suffix")).join(between, ["target", "key"]), "import_map_suffix")
    way(calls.withColumn("key", F.concat_ws(".", "module", "callee")).join(whole, "key"), "same_module")
    way(calls.filter("suffix <> ''").withColumn("key", F.col("callee")).join(ends.groupBy("key").agg(first), "key"), "qualified_suffix")
    by_name = names.groupBy("last").agg(F.count("*").alias("n"), first)
    homes = names.select("last", "qn", "target_id", F.explode(_prefixes(F.col("home"))).alias("reached")).groupBy("last", "reached").agg(first)
    reachable = calls.select("module", "last").distinct().join(imports.select("module", F.col("target").alias("reached")).distinct(), "module")
    reachable = reachable.join(homes, ["last", "reached"]).groupBy("module", "last").agg(F.min("best").alias("near"))
    named = calls.join(by_name, "last").join(reachable, ["module", "last"], "left")
    reach = F.col("near").isNotNull()
    way(named.filter("n = 1"), "unique_name", F.when(reach, CONFIDENCE["unique_name"]).otherwise(CONFIDENCE["unique_name"] * 0.5))
    share = F.least(F.lit(1.0), F.lit(3.0) / F.col("n")) * CONFIDENCE["suffix_match"]
    way(named.filter("n > 1").withColumn("best", F.coalesce("near", "best")), "suffix_match", F.when(reach, share).otherwise(share * 0.5))
    rank = F.lit(99)
    for i, name in enumerate(CONFIDENCE):
        rank = F.when(F.col("strategy") == name, i).otherwise(rank)
    best = reduce(DataFrame.unionByName, ways).groupBy("call_id").agg(F.min_by(F.struct("target_id", "strategy", "confidence"), F.struct(rank, "qn", "target_id")).alias("b"))
    return best.select("call_id", "b.*")


def longest_prefix(specifiers: DataFrame, prefixes: DataFrame) -> DataFrame:
    """specifier, module: the module of the longest prefix that ends where the specifier ends or at a slash or dot.

    Each specifier lists its own prefixes and meets the table by equality.
    """
    cuts = F.transform(F.sequence(F.lit(1), F.length("specifier")), lambda i: F.when((i == F.length("specifier")) | F.substr("specifier", i + 1, F.lit(1)).isin("/", "."), F.substr("specifier", F.lit(1), i)))
    own = specifiers.filter("specifier <> ''").select("specifier", F.explode(F.filter(cuts, lambda c: c.isNotNull())).alias("prefix"))
    return own.join(prefixes, "prefix").groupBy("specifier").agg(F.max_by("module", F.struct(F.length("prefix"), "module")).alias("module"))


# -- tags, configuration, tests


def tag_words(decorated: DataFrame) -> DataFrame:
    """id, tags: words of a node's decorators that stand on two nodes or more. decorated: id, decorators."""
    words = decorated.select("id", F.explode("decorators").alias("d")).select("id", F.explode(scalar.decorator_tokens(F.col("d"))).alias("word")).distinct()
    common = words.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")
    return words.join(common.select("word"), "word").groupBy("id").agg(F.array_sort(F.collect_set("word")).alias("tags"))


def config_links(nodes: DataFrame) -> DataFrame:
    """source_id, target_id, confidence, config_key: symbols that a configuration key names, whole (0.85) or in part (0.75).

    A name gives its parts of the lengths that keys have and of no other, and meets the keys by equality; of two keys or
    more of a length each part is one row.
    """
    key = scalar.config_key(F.col("name"))
    config = nodes.filter((F.col("label") == "Variable") & scalar.is_config_path(F.col("file_path"))).select(F.col("id").alias("target_id"), F.col("name").alias("config_key"), key.alias("norm"))
    parts = F.split("norm", "_")
    config = config.filter((F.size(parts) >= 2) & F.forall(parts, lambda w: F.length(w) >= 3))
    code = nodes.filter(F.col("label").isin("Function", "Variable", "Class", "Struct") & ~scalar.is_config_path(F.col("file_path"))).select(F.col("id").alias("source_id"), key.alias("own")).filter("own <> ''")
    # the lengths of keys, and for each the texts that keys begin with: few numbers, and three letters that rule most parts out
    heads = config.select(F.length("norm").alias("size"), F.substring("norm", 1, 3).alias("head")).distinct()
    starts = code.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.length("own") - 6, F.lit(1))))).withColumn("head", F.expr("substr(own, at, 3)"))
    found = starts.join(heads, "head").filter("at + size - 1 <= length(own)").withColumn("norm", F.expr("substr(own, at, size)"))
    found = found.select("source_id", "own", "norm").distinct().join(config, "norm")
    return found.select("source_id", "target_id", F.when(F.col("own") == F.col("norm"), 0.85).otherwise(0.75).alias("confidence"), "config_key")


def dependency_imports(dependencies: DataFrame, imports: DataFrame) -> DataFrame:
    """dependency_id, import_id, confidence: same name (0.95), or a segment of the qualified name (0.80)."""
    d = dependencies.select("dependency_id", F.lower("name").alias("word"))
    words = imports.select("import_id", F.lower("name").alias("_name"), F.explode(F.array_distinct(F.concat(F.array(F.lower("name")), F.split(F.lower("qualified_name"), r"[./]")))).alias("word"))
    return words.join(d, "word").select("dependency_id", "import_id", F.when(F.col("_name") == F.col("word"), 0.95).otherwise(0.80).alias("confidence")).distinct()


def config_references(config_files: DataFrame, strings: DataFrame) -> DataFrame:
    """file_id, user_id, confidence: strings that are a configuration file's path (0.90) or base name (0.70)."""
    base = F.element_at(F.split("path", "/"), -1)
    by_path = config_files.select("file_id", F.col("path").alias("text"), F.lit(0.90).alias("confidence"))
    by_name = config_files.select("file_id", base.alias("text"), F.lit(0.70).alias("confidence"))
    return by_path.union(by_name).join(strings, "text").groupBy("file_id", "user_id").agg(F.max("confidence").alias("confidence"))


def tests_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """TESTS edges (source_id, target_id): calls from a test's function to what is no test."""
    flag = F.coalesce(F.get_json_object("properties", "$.is_test") == "true", F.lit(False)) | scalar.is_test_path(F.col("file_path"))
    marks = nodes.select("id", flag.alias("test"), scalar.is_test_name(F.col("name")).alias("named"))
    calls = edges.filter("type = 'CALLS'").select("source_id", "target_id")
    from_test = calls.join(marks.filter("test and named").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return from_test.join(marks.filter("not test").select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id").distinct()


def tests_files(files: DataFrame) -> DataFrame:
    """TESTS_FILE edges (source_id, target_id): a test file and the file beside it, or anywhere, of the name it is for."""
    base = F.element_at(F.split("file_path", "/"), -1)
    plain = F.regexp_replace(F.regexp_replace(base, r"^test_", ""), r"(?:_test|_spec|\.test|\.spec|Test|Spec)(?=\.[^.]+$)", "")
    tests = files.filter(scalar.is_test_path(F.col("file_path"))).select(F.col("id").alias("source_id"), plain.alias("base"))
    code = files.filter(~scalar.is_test_path(F.col("file_path"))).select(F.col("id").alias("target_id"), base.alias("base"))
    return tests.join(code, "base").select("source_id", "target_id")


# -- routes and services


def routes(edges: DataFrame) -> DataFrame:
    """route, method: distinct canonical routes that calls or handlers name in url_path and method."""
    path = F.get_json_object("properties", "$.url_path")
    method = F.coalesce(F.upper(F.get_json_object("properties", "$.method")), F.lit("ANY"))
    return edges.filter(path.isNotNull()).select(scalar.route_canonical(path).alias("route"), method.alias("method")).distinct()


def route_matches(calls: DataFrame, handlers: DataFrame) -> DataFrame:
    """call_id, handler_id: paths that agree segment by segment, where {} stands for any, and methods that agree or are ANY.

    calls, handlers: call_id or handler_id, path, method. Equal paths are one row each before they meet. Two paths that
    agree have equal texts at every place where neither has {}; they meet by their pattern of places and by the texts at
    the places that the two patterns have in common, so the patterns, not the paths, are compared with each other.
    """
    segments = lambda path: F.split(scalar.route_canonical(path), "/")
    method = F.upper(F.coalesce("method", F.lit("ANY")))

    def parted(df: DataFrame, side: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        rows = df.select(f"{side}_id", segments(F.col("path")).alias("path"), method.alias(f"{side}_method"))
        paths = rows.select("path").distinct().withColumn("mask", F.transform("path", lambda s: ~s.contains("{}")))
        return rows.withColumnRenamed("path", f"{side}_path"), paths.toDF(f"{side}_path", f"{side}_mask"), paths.select("mask").distinct().withColumnRenamed("mask", f"{side}_mask")

    c_rows, c, c_masks = parted(calls, "call")
    h_rows, h, h_masks = parted(handlers, "handler")
    both = c_masks.withColumn("n", F.size("call_mask")).join(h_masks.withColumn("n", F.size("handler_mask")), "n")
    both = both.select("call_mask", "handler_mask", F.zip_with("call_mask", "handler_mask", lambda a, b: a & b).alias("common"))

    def keyed(df: DataFrame, side: str) -> DataFrame:
        shown = F.transform(F.arrays_zip(F.col(f"{side}_path").alias("p"), F.col("common").alias("m")), lambda x: F.when(x["m"], x["p"]).otherwise("{}"))
        return df.join(both, f"{side}_mask").select(f"{side}_path", "call_mask", "handler_mask", shown.alias("shown"))

    met = keyed(c, "call").join(keyed(h, "handler"), ["call_mask", "handler_mask", "shown"]).select("call_path", "handler_path")
    methods = (F.col("call_method") == F.col("handler_method")) | (F.col("call_method") == "ANY") | (F.col("handler_method") == "ANY")
    return c_rows.join(met, "call_path").join(h_rows, "handler_path").filter(methods).select("call_id", "handler_id").distinct()


def route_targets(routes: DataFrame, records: DataFrame) -> DataFrame:
    """INFRA_MAPS (source_id, target_id): topics, queues and schedules bound to a URL, and the route of its path.

    records: id, url; routes: id, path. Equal canonical paths.
    """
    asked = records.select(F.col("id").alias("source_id"), scalar.route_canonical(scalar.url_path(F.col("url"))).alias("route")).filter("route <> ''")
    return asked.join(routes.select(F.col("id").alias("target_id"), scalar.route_canonical(F.col("path")).alias("route")), "route").select("source_id", "target_id").distinct()


def config_routes(files: DataFrame) -> DataFrame:
    """route, file_path: canonical paths of the URLs that configuration files hold. files: file_path, content."""
    urls = F.explode(F.regexp_extract_all("content", F.lit(r"https?://[^\s'\"<>,;)]+"), 0)).alias("url")
    own = files.filter(scalar.is_config_path(F.col("file_path"))).select("file_path", urls)
    return own.select(scalar.route_canonical(scalar.url_path(F.col("url"))).alias("route"), "file_path").filter("route <> ''").distinct()


def file_routes(files: DataFrame) -> DataFrame:
    """route, method, file_path of files whose place is their route: src/routes/a/[id]/+server.ts is /a/{}.

    Pages answer GET, servers any method; groups in parentheses are no segments, [...rest] and [id] stand for any text.
    """
    pattern = r"(?:^|/)src/routes/(?:(.*)/)?\+(page|server)(?:\.server)?\.(?:svelte|ts|js)$"
    own = files.filter(F.col("file_path").rlike(pattern)).select("file_path", F.regexp_extract("file_path", pattern, 1).alias("folder"), F.regexp_extract("file_path", pattern, 2).alias("kind"))
    parts = F.filter(F.split("folder", "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$"))
    route = F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.regexp_replace(s, r"\[+[^\]]*\]+", "{}")), "/"))
    return own.select(route.alias("route"), F.when(F.col("kind") == "page", "GET").otherwise("ANY").alias("method"), "file_path").distinct()


def grpc_routes(services: DataFrame) -> DataFrame:
    """route, id of remote procedures: /package.Service/Method. services: id, package, service, method."""
    name = F.concat_ws(".", F.when(F.col("package") != "", F.col("package")), "service")
    return services.select(F.concat(F.lit("/"), name, F.lit("/"), F.col("method")).alias("route"), "id").distinct()


def data_flows(edges: DataFrame) -> DataFrame:
    """DATA_FLOWS edges: from whoever calls a route to whoever handles it."""
    calls = edges.filter(F.col("type").isin("HTTP_CALLS", "ASYNC_CALLS")).select("source_id", F.col("target_id").alias("route"))
    handles = edges.filter("type = 'HANDLES'").select(F.col("source_id").alias("handler"), F.col("target_id").alias("route"))
    return calls.join(handles, "route").select("source_id", F.col("handler").alias("target_id"), "route").distinct()


#: Pairs of one key that a task makes, about, and tasks of a join of pairs at most.
PAIRS, TASKS = 2_000_000, 10_000


def cross_project(callers: DataFrame, handlers: DataFrame, kind: str = "CROSS_HTTP_CALLS") -> DataFrame:
    """Edges between projects that name the same route, channel or service, each way. callers, handlers: project, id, key.

    Each edge comes once without the edges being shuffled: only ends with several keys, or that both call and handle,
    can meet twice, and only what two such ends have in common is made distinct. A key's pairs are dealt over tasks.
    """
    ends = callers.select("project", "id", "key", F.lit(True).alias("calls")).union(handlers.select("project", "id", "key", F.lit(False))).filter("key is not null").distinct()
    own, role = Window.partitionBy("project", "id"), Window.partitionBy("project", "id", "calls")
    ends = cut(ends.withColumns({"many": F.count("*").over(role) > 1, "both": F.count("*").over(own) > F.count("*").over(role)}))
    sides = ends.groupBy("key").agg(F.count(F.when(F.col("calls"), 1)).alias("n"), F.count(F.when(~F.col("calls"), 1)).alias("m"))
    parts = cut(sides.filter("n > 0 and m > 0").select("key", F.least("n", F.ceil(F.col("n") * F.col("m") / PAIRS)).cast("int").alias("parts")))
    tasks = max(1, min(parts.agg(F.sum("parts")).head()[0] or 0, TASKS))
    a = ends.filter("calls").join(parts, "key").select("key", F.pmod(F.xxhash64("project", "id"), "parts").cast("int").alias("part"), F.col("project").alias("pa"), F.col("id").alias("a"), F.col("many").alias("ma"), F.col("both").alias("ba"))
    b = ends.filter("not calls").join(parts, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("project").alias("pb"), F.col("id").alias("b"), F.col("many").alias("mb"), F.col("both").alias("bb"))
    met = a.repartition(tasks, "key", "part").join(b.repartition(tasks, "key", "part"), ["key", "part"]).filter("pa <> pb")
    twice = (F.col("ma") & F.col("mb")) | (F.col("ba") & F.col("bb"))
    out = _both_ways(met.filter(~twice), kind)
    if ends.filter("many or both").isEmpty():
        return out
    return out.unionByName(_each_way(met.filter(twice), kind))


def cross_project_routes(callers: DataFrame, handlers: DataFrame, kind: str = "CROSS_HTTP_CALLS") -> DataFrame:
    """The same for routes: project, id, path, method. A call whose path no other project handles as it is goes by templates."""
    a = callers.select(F.col("project").alias("pa"), F.col("id").alias("a"), "path", F.upper(F.coalesce("method", F.lit("ANY"))).alias("ma"))
    b = handlers.select(F.col("project").alias("pb"), F.col("id").alias("b"), "path", F.upper(F.coalesce("method", F.lit("ANY"))).alias("mb"))
    exact = a.join(b, "path").filter("pa <> pb and (ma = mb or ma = 'ANY' or mb = 'ANY')").select("pa", "a", "pb", "b")
    rest = callers.join(exact.select(F.col("pa").alias("project"), F.col("a").alias("id")).distinct(), ["project", "id"], "left_anti")
    pair = F.struct("project", "id")
    met = route_matches(rest.select(pair.alias("call_id"), "path", "method"), handlers.select(pair.alias("handler_id"), "path", "method"))
    loose = met.select(F.col("call_id.project").alias("pa"), F.col("call_id.id").alias("a"), F.col("handler_id.project").alias("pb"), F.col("handler_id.id").alias("b")).filter("pa <> pb")
    return _each_way(exact.union(loose), kind)


def _both_ways(both: DataFrame, kind: str) -> DataFrame:
    """Both edges of each pair from one reading of the pairs; a pair must come once."""
    one = F.struct(F.col("pa").alias("project"), F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("pb").alias("target_project"))
    back = F.struct(F.col("pb").alias("project"), F.col("b").alias("source_id"), F.col("a").alias("target_id"), F.col("pa").alias("target_project"))
    return both.select(F.explode(F.array(one, back)).alias("e")).select("e.*", F.lit(kind).alias("type"))


def _each_way(both: DataFrame, kind: str) -> DataFrame:
    out = both.select(F.col("pa").alias("project"), F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("pb").alias("target_project"))
    back = both.select(F.col("pb").alias("project"), F.col("b").alias("source_id"), F.col("a").alias("target_id"), F.col("pa").alias("target_project"))
    return out.union(back).distinct().withColumn("type", F.lit(kind))


def implementations(classes: DataFrame, interfaces: DataFrame) -> DataFrame:
    """class_id, interface_id where the class has every method of the interface. classes, interfaces: id, method."""
    need = interfaces.select(F.col("id").alias("interface_id"), "method").distinct()
    have = classes.select(F.col("id").alias("class_id"), "method").distinct()
    met = have.join(need, "method").groupBy("class_id", "interface_id").agg(F.count("*").alias("n"))
    return met.join(need.groupBy("interface_id").agg(F.count("*").alias("n")), ["interface_id", "n"]).select("class_id", "interface_id")


def overrides(classes: DataFrame, interfaces: DataFrame) -> DataFrame:
    """OVERRIDE (source_id, target_id): a method of a class and the one it stands for of an interface that the class fulfils.

    classes, interfaces: id, method, method_id.
    """
    pairs = implementations(classes.select("id", "method"), interfaces.select("id", "method"))
    own = pairs.join(classes.select(F.col("id").alias("class_id"), "method", F.col("method_id").alias("source_id")), "class_id")
    return own.join(interfaces.select(F.col("id").alias("interface_id"), "method", F.col("method_id").alias("target_id")), ["interface_id", "method"]).select("source_id", "target_id").distinct()


def folder_chain(files: DataFrame) -> DataFrame:
    """parent, child, kind (folder or file) of every path; the root is the empty path. files: file_path."""
    def steps(parts: Column) -> Column:
        every = F.sequence(F.lit(1), F.size(parts))
        kind = lambda i: F.when(i == F.size(parts), "file").otherwise("folder")
        return F.transform(every, lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("parent"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("child"), kind(i).alias("kind")))

    return files.select(F.explode(scalar.let(F.split("file_path", "/"), steps)).alias("s")).select("s.*").distinct()


#: Words in a call's name that tell what service it reaches.
SERVICE_PATTERNS = {
    "http": ("requests.", "httpx.", "fetch", "axios", "http.get", "http.post", "urllib", "resttemplate", "webclient"),
    "async": ("publish", "send_message", "enqueue", "produce", "celery", "pubsub", "kafka", "rabbitmq", "sqs"),
    "grpc": ("grpc", "stub."),
    "graphql": ("graphql", "gql"),
    "trpc": ("trpc",),
    "config": ("getenv", "environ", "config.get", "viper"),
    "route": ("app.get", "app.post", "router.", "@app.route", "handlefunc", "mapget", "mappost"),
}


def service_kind(callee: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, words in reversed(SERVICE_PATTERNS.items()):
        out = F.when(reduce(lambda a, b: a | b, (F.lower(callee).contains(w) for w in words)), kind).otherwise(out)
    return out


def service_workloads(services: DataFrame, workloads: DataFrame) -> DataFrame:
    """INFRA_MAPS (service_id, workload_id): a selector value is the workload's name or one of its labels' values."""
    have = workloads.select("workload_id", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce(F.map_values("labels"), F.array().cast("array<string>"))))).alias("value"))
    want = services.select("service_id", F.explode(F.map_values("selector")).alias("value"))
    return want.join(have, "value").select("service_id", "workload_id").distinct()


def record_edges(records: DataFrame, kind: str, items: str, type_name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges for names that records list, such as channels, environment variables or chart dependencies.

    records: id and an array column `items`. Nodes: label, name; edges: source_id, name, type.
    """
    own = records.select("id", F.explode(items).alias("name")).filter("name is not null and name <> ''").distinct()
    return own.select(F.lit(kind).alias("label"), "name").distinct(), own.select(F.col("id").alias("source_id"), "name", F.lit(type_name).alias("type"))


def injected_calls(signatures: DataFrame) -> DataFrame:
    """call_id, callee of each Depends(name) in a signature. signatures: call_id, signature."""
    return signatures.select("call_id", F.explode(F.regexp_extract_all("signature", F.lit(r"Depends\(\s*([A-Za-z_][\w.]*)"), 1)).alias("callee"))


#: Names too common to trust when only a name is known.
WEAK_NAMES = ("print", "push", "pop", "shift", "join", "split", "keys", "values", "map", "sort", "length", "get", "set", "add", "then", "catch", "forEach", "filter", "log")


def without_weak(resolved: DataFrame) -> DataFrame:
    """Resolutions by name alone of names that every language has are dropped. resolved: callee, strategy."""
    weak = F.col("strategy").isin("unique_name", "suffix_match") & _last(F.col("callee")).isin(*WEAK_NAMES)
    return resolved.filter(~weak)


def best_callee(candidates: DataFrame) -> DataFrame:
    """call_id, target_id, confidence: of several findings the surest, of equal ones the lesser id."""
    best = F.max_by(F.struct("target_id", "confidence"), F.struct("confidence", -F.col("target_id"))).alias("b")
    return candidates.groupBy("call_id").agg(best).select("call_id", "b.*")
