"""Text formats to rows. Every reader takes a table of texts and explodes it with expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

# -- version control


def name_status(texts: DataFrame, text: str = "text") -> DataFrame:
    """status (A, M, D, R, C), path, old_path of each line of `diff --name-status`."""
    line = F.explode(F.split(text, "\n")).alias("line")
    parts = F.split("line", "\t")
    own = texts.select(line).filter(F.col("line").rlike(r"^[AMDRCT]\d*\t"))
    two = F.size(parts) >= 3
    return own.select(F.substr("line", F.lit(1), F.lit(1)).alias("status"), F.when(two, parts[2]).otherwise(parts[1]).alias("path"), F.when(two, parts[1]).alias("old_path"))


def hunks(texts: DataFrame, text: str = "text") -> DataFrame:
    """file_path, start, end of each hunk's new lines in a `diff --unified=0`."""
    files = texts.select(F.explode(F.split(F.concat(F.lit("\n"), text), r"\ndiff --git ")).alias("part"))
    path = F.regexp_extract("part", r"(?m)^\+\+\+ (?:b/)?([^\t\n]+)", 1).alias("file_path")
    ranges = F.explode(F.regexp_extract_all("part", F.lit(r"(?m)^@@ -\S+ \+(\S+) @@"), 1)).alias("range")
    own = files.select(path, ranges).filter("file_path <> '' and file_path <> '/dev/null'")
    return own.select("file_path", scalar.diff_range(F.col("range")).alias("r")).select("file_path", "r.start", "r.end")


def git_log(texts: DataFrame, text: str = "text") -> DataFrame:
    """commit, ts, file of a log whose commits begin with `COMMIT:<hash>|<unix time>` and list their files."""
    parts = texts.select(F.explode(F.split(text, r"(?m)^COMMIT:")).alias("part")).filter(F.col("part").rlike(r"^[0-9a-f]+\|\d+"))
    files = F.filter(F.split("part", "\n"), lambda l: (l != "") & ~l.rlike(r"^[0-9a-f]+\|\d+"))
    return parts.select(F.regexp_extract("part", r"^([0-9a-f]+)\|", 1).alias("commit"), F.regexp_extract("part", r"\|(\d+)", 1).cast("bigint").alias("ts"), F.explode(files).alias("file"))


# -- infrastructure files


def assignments(files: DataFrame) -> DataFrame:
    """file_path, key, value of dotenv, shell and Dockerfile assignments. files: file_path, content."""
    line = F.explode(F.split("content", "\n")).alias("line")
    own = files.select("file_path", line)
    pattern = r"^\s*(?:export\s+|ENV\s+|ARG\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*[\"']?([^\"'\n]*?)[\"']?\s*$"
    return own.filter(F.col("line").rlike(pattern)).select("file_path", F.regexp_extract("line", pattern, 1).alias("key"), F.regexp_extract("line", pattern, 2).alias("value"))


# What marks a key or a value as secret.
SECRET_KEY = r"(?i)(secret|password|passwd|token|api_?key|private|credential|auth)"
SECRET_VALUE = r"(?i)(-----BEGIN|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|://[^/\s:@]+:[^/\s:@]+@)"


def env_urls(files: DataFrame) -> DataFrame:
    """Assignments whose value is a URL, without secrets."""
    own = assignments(files)
    return own.filter(F.col("value").rlike(r"^[a-z][a-z0-9+.-]*://") & ~F.col("key").rlike(SECRET_KEY) & ~F.col("value").rlike(SECRET_VALUE))


def dockerfiles(files: DataFrame) -> DataFrame:
    """file_path, base_images, ports, entry of each Dockerfile."""
    return files.select(
        "file_path",
        F.regexp_extract_all("content", F.lit(r"(?im)^\s*FROM\s+(?:--\S+\s+)?(\S+)"), 1).alias("base_images"),
        F.regexp_extract_all("content", F.lit(r"(?im)^\s*EXPOSE\s+(\d+)"), 1).alias("ports"),
        F.regexp_extract("content", r"(?im)^\s*(?:ENTRYPOINT|CMD)\s+(.+)$", 1).alias("entry"),
    )


def terraform(files: DataFrame) -> DataFrame:
    """file_path, block, kind, name of each block with a name."""
    blocks = F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*((?:resource|data|module|variable|output|provider)(?:\s+\"[^\"]+\"){1,2})\s*\{"), 1)).alias("head")
    own = files.select("file_path", blocks)
    names = F.regexp_extract_all("head", F.lit(r'"([^"]+)"'), 1)
    return own.select("file_path", F.regexp_extract("head", r"^(\w+)", 1).alias("block"), F.when(F.size(names) > 1, names[0]).alias("kind"), F.element_at(names, -1).alias("name"))


def kubernetes(files: DataFrame) -> DataFrame:
    """file_path, kind, name, selector of each document of a manifest; a document is split at ---."""
    docs = files.select("file_path", F.explode(F.split("content", r"(?m)^---\s*$")).alias("doc")).filter(F.col("doc").rlike(r"(?m)^kind:\s*\w+"))
    block = F.regexp_extract("doc", r"(?m)^\s*selector:\s*\n((?:\s+(?:matchLabels:)?.*\n?)+?)(?=^\s{0,2}\w|\Z)", 1)
    pairs = F.regexp_extract_all(block, F.lit(r"(?m)^\s+([\w./-]+:\s*[\w./-]+)\s*$"), 1)
    selector = F.map_from_entries(F.transform(F.array_distinct(pairs), lambda p: F.struct(F.regexp_extract(p, r"^([\w./-]+):", 1), F.regexp_extract(p, r":\s*([\w./-]+)$", 1))))
    return docs.select("file_path", F.regexp_extract("doc", r"(?m)^kind:\s*(\w+)", 1).alias("kind"), F.regexp_extract("doc", r"(?m)^metadata:\s*\n(?:\s+.*\n)*?\s+name:\s*(\S+)", 1).alias("name"), selector.alias("selector"))


def chart_dependencies(files: DataFrame) -> DataFrame:
    """file_path, dependency of each chart's dependency list."""
    block = F.regexp_extract("content", r"(?ms)^dependencies:\s*\n(.*?)(?=^\w|\Z)", 1)
    return files.select("file_path", F.explode(F.regexp_extract_all(block, F.lit(r"(?m)^\s*-?\s*name:\s*(\S+)"), 1)).alias("dependency"))


def _begins(mark: str):
    return lambda w: w.startswith(mark)


def compile_commands(texts: DataFrame, text: str = "text") -> DataFrame:
    """directory, file, includes, defines of a compilation database."""
    rows = texts.select(F.explode(F.from_json(text, "array<struct<directory: string, file: string, command: string, arguments: array<string>>>")).alias("c")).select("c.*")
    words = F.coalesce("arguments", F.split("command", r"\s+"))
    return rows.select("directory", "file", *(F.transform(F.filter(words, _begins(f)), lambda w: F.substr(w, F.lit(3))).alias(n) for n, f in (("includes", "-I"), ("defines", "-D"))))


def manifests(files: DataFrame) -> DataFrame:
    """file_path, dependency of package manifests: package.json, requirements.txt, go.mod, Cargo.toml."""
    name = F.element_at(F.split("file_path", "/"), -1)
    json = F.concat(*(F.coalesce(F.map_keys(F.from_json(F.get_json_object("content", f"$.{k}"), "map<string, string>")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")))
    found = (
        F.when(name == "package.json", json)
        .when(name.rlike(r"^requirements.*\.txt$"), F.regexp_extract_all("content", F.lit(r"(?m)^\s*([A-Za-z0-9][\w.-]*)"), 1))
        .when(name == "go.mod", F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+v\d"), 1))
        .when(name == "Cargo.toml", F.regexp_extract_all(F.regexp_extract("content", r"(?s)\[dependencies\](.*?)(?=\n\[|\z)", 1), F.lit(r"(?m)^\s*([\w-]+)\s*="), 1))
    )
    return files.select("file_path", F.explode(F.array_distinct(found)).alias("dependency"))


def path_aliases(texts: DataFrame, text: str = "text") -> DataFrame:
    """alias, target of a TypeScript configuration's paths."""
    rows = F.explode(F.from_json(F.get_json_object(text, "$.compilerOptions.paths"), "map<string, array<string>>")).alias("alias", "targets")
    return texts.select(rows).select(F.regexp_replace("alias", r"/\*$", "").alias("alias"), F.regexp_replace(F.element_at("targets", 1), r"/\*$", "").alias("target"))


# -- traces

SPAN = "struct<kind: int, attributes: array<struct<key: string, value: string>>, start: string, end: string>"


def span_facts(spans: DataFrame) -> DataFrame:
    """method, path, status, service, duration_ns of the spans that are HTTP. spans: a column span of type SPAN, and service."""
    attrs = F.map_from_entries(F.col("span.attributes"))

    def first(*keys: str) -> Column:
        return F.coalesce(*(F.try_element_at(attrs, F.lit(k)) for k in keys))

    method, url = first("http.method", "http.request.method"), first("url.full", "http.url")
    path = F.coalesce(first("http.route", "url.path", "http.target"), scalar.url_path(url))
    own = spans.filter(method.isNotNull() | url.isNotNull() | first("http.route", "url.path", "http.target").isNotNull())
    status = first("http.status_code", "http.response.status_code").try_cast("int")
    return own.select(method.alias("method"), path.alias("path"), status.alias("status"), "service", scalar.duration_ns(F.col("span.start"), F.col("span.end")).alias("duration_ns"))


def p99(values: Column) -> Column:
    """The sorted value at place floor(0.99 n), the last at most; 0 of none."""
    n = F.size(values)
    at = F.least((F.floor(n * F.lit(0.99)) + 1).cast("int"), n)
    return F.when(n > 0, F.element_at(F.array_sort(values), at)).otherwise(0)


def p99_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, p99 without a list per group: counts of equal values, their running sum, and the first past the place."""
    from pyspark.sql import Window

    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = F.least(F.floor(F.col("n") * F.lit(0.99)) + 1, F.col("n"))
    return counts.withColumn("_upto", upto).join(total, keys).filter(F.col("_upto") >= place).groupBy(*keys, "n").agg(F.min(value).alias("p99"))
