"""The scalar library. Unless said otherwise a null argument gives null."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once however often body, or a lambda in it, says it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# -- text and conversion


def to_integer(x: Column) -> Column:
    """The leading whole number of a text, else null: '1.9' is 1, '12x' is 12."""
    return F.regexp_extract(F.trim(x.cast("string")), r"^[+-]?\d+", 0).try_cast("bigint")


def to_float(x: Column) -> Column:
    return F.regexp_extract(F.trim(x.cast("string")), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0).try_cast("double")


def to_boolean(x: Column) -> Column:
    low = F.lower(x.cast("string"))
    return F.when(low == "true", True).when(low == "false", False)


_BLANK = r"[ \t\r\n]+"


def trim(x: Column) -> Column:
    """Spaces, tabs and line breaks go from both ends; ltrim and rtrim take one end."""
    return F.regexp_replace(x, rf"^{_BLANK}|{_BLANK}$", "")


def ltrim(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{_BLANK}", "")


def rtrim(x: Column) -> Column:
    return F.regexp_replace(x, rf"{_BLANK}$", "")


def coalesce(*xs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(x.cast("string") != "", x) for x in xs))


def substring(x: Column, start: Column, n: Column | None = None) -> Column:
    """From a place counted from 0; outside the text it is empty."""
    at = start.cast("int")
    size = F.length(x) if n is None else F.greatest(n.cast("int"), F.lit(0))
    return F.when((at < 0) | (at >= F.length(x)), F.when(x.isNotNull(), "")).otherwise(F.substr(x, at + 1, size))


def left(x: Column, k: Column) -> Column:
    return F.left(x, F.greatest(k.cast("int"), F.lit(0)))


def right(x: Column, k: Column) -> Column:
    return F.right(x, F.greatest(k.cast("int"), F.lit(0)))


def replace(x: Column, old: Column, new: Column) -> Column:
    return F.when(old == "", x).otherwise(F.replace(x, old, new))


#: By their lower-case names in queries.
QUERY_FUNCTIONS = {
    "tolower": F.lower,
    "toupper": F.upper,
    "tostring": lambda x: x.cast("string"),
    "tointeger": to_integer,
    "tofloat": to_float,
    "toboolean": to_boolean,
    "size": lambda x: F.length(x.cast("string")),
    "length": lambda x: F.length(x.cast("string")),
    "trim": trim,
    "ltrim": ltrim,
    "rtrim": rtrim,
    "reverse": F.reverse,
    "coalesce": coalesce,
    "substring": substring,
    "left": left,
    "right": right,
    "replace": replace,
}

# -- vectors and patterns


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a vector has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def camel_split(x: Column) -> Column:
    """The text, a space, and the text split at its humps."""
    split = F.regexp_replace(x, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.when(x == "", "").otherwise(F.concat_ws(" ", x, split))


def regexp(pattern: str, x: Column) -> Column:
    return x.rlike(pattern)


def iregexp(pattern: str, x: Column) -> Column:
    return x.rlike(f"(?i){pattern}")


def glob_to_like(pattern: str | None) -> str | None:
    """**, * and a slash beside ** are %, ? is _."""
    if pattern is None:
        return None
    out = re.sub(r"/?\*\*$", "%", pattern)
    out = re.sub(r"\*\*/", "%", out)
    return out.replace("**", "%").replace("*", "%").replace("?", "_")


def like_hints(pattern: str | None) -> list[str]:
    """Literal runs of three characters or more that any match holds; none if the pattern has alternatives."""
    if pattern is None or "|" in pattern:
        return []
    parts = re.split(r"(?:\\.|\[[^\]]*\]|[.^$*+?(){}]|\[|\])+", pattern)
    return [p for p in parts if len(p) >= 3]


def ignore_case(pattern: str) -> str:
    return pattern if pattern.startswith("(?i)") else f"(?i){pattern}"


def keep_case(pattern: str) -> str:
    return pattern.removeprefix("(?i)")


# -- names and paths


def package(qualified_name: Column) -> Column:
    """Of four segments or more the third, of two or three the second, else empty."""
    parts = F.split(F.coalesce(qualified_name, F.lit("")), r"\.")
    return F.when(F.size(parts) >= 4, parts[2]).when(F.size(parts) >= 2, parts[1]).otherwise("")


def top_package(qualified_name: Column) -> Column:
    parts = F.split(F.coalesce(qualified_name, F.lit("")), r"\.")
    return F.when(F.size(parts) >= 2, parts[1]).otherwise("")


def is_test_file(path: Column) -> Column:
    """The narrow test: a path that says "test"."""
    return F.coalesce(path.contains("test"), F.lit(False))


# Endings, infixes and folders of test files, prefixes and names of test functions.
TEST_ENDINGS = ("_test.go", "_test.py", "_test.rs", "_test.cpp", "_test.lua", "Test.java", "Test.kt", "Test.cs", "Test.php", "Spec.scala", "_spec.rb")
TEST_INFIXES = (".test.ts", ".spec.ts", ".test.js", ".spec.js")
TEST_FOLDERS = ("__tests__", "tests", "test", "spec")
TEST_PREFIXES = ("Test", "Benchmark", "Example")
TEST_NAMES = ("test", "it", "describe", "beforeAll", "afterAll", "beforeEach", "afterEach")


def _any_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")"


def is_test_path(path: Column) -> Column:
    """The wide test, over many languages' conventions."""
    folder = rf"(?:^|/){_any_of(TEST_FOLDERS)}/"
    return F.coalesce(path.rlike(rf"(?:^|/)test_[^/]*$|{_any_of(TEST_ENDINGS)}$|{_any_of(TEST_INFIXES)}|{folder}|__tests__/"), F.lit(False))


def is_test_name(name: Column) -> Column:
    return F.coalesce(name.rlike(rf"^{_any_of(TEST_PREFIXES)}(?:$|[A-Z])|^test_|^test[A-Z]") | name.isin(*TEST_NAMES), F.lit(False))


def is_env_name(x: Column) -> Column:
    return F.coalesce(x.rlike("^[A-Z0-9_]{2,}$") & x.rlike("[A-Z]"), F.lit(False))


#: Endings of configuration files.
CONFIG_ENDINGS = (".toml", ".ini", ".yaml", ".yml", ".cfg", ".properties", ".json", ".xml", ".conf", ".env")


def is_config_path(path: Column) -> Column:
    return F.coalesce(path.rlike(rf"{_any_of(CONFIG_ENDINGS)}$"), F.lit(False))


def config_key(x: Column) -> Column:
    """Split at _, -, ., spaces and humps, in lower case, joined by _."""
    spaced = F.regexp_replace(x, r"(?<=[a-z])(?=[A-Z])", " ")
    words = F.filter(F.split(F.lower(spaced), r"[_\-. ]+"), lambda w: w != "")
    return F.array_join(words, "_")


def config_words(x: Column) -> Column:
    return F.when(config_key(x) == "", 0).otherwise(F.size(F.split(config_key(x), "_")))


# Abbreviations in code and what they stand for.
ABBREVIATIONS = {
    "err": "error", "exc": "exception", "ex": "exception", "ctx": "context", "cfg": "config", "conf": "configuration", "env": "environment",
    "opt": "option", "opts": "options", "req": "request", "res": "response", "resp": "response", "rsp": "response", "hdr": "header",
    "hdrs": "headers", "str": "string", "fmt": "format", "msg": "message", "txt": "text", "lbl": "label", "desc": "description", "buf": "buffer",
    "arr": "array", "vec": "vector", "lst": "list", "dict": "dictionary", "tbl": "table", "stk": "stack", "que": "queue", "fn": "function",
    "func": "function", "cb": "callback", "proc": "procedure", "ctor": "constructor", "dtor": "destructor", "db": "database", "col": "column",
    "stmt": "statement", "txn": "transaction", "trx": "transaction", "repo": "repository", "auth": "authentication", "authz": "authorization",
    "perm": "permission", "cred": "credential", "tok": "token", "pwd": "password", "val": "value", "num": "number", "int": "integer",
    "bool": "boolean", "flt": "float", "dbl": "double", "idx": "index", "iter": "iterator", "elem": "element", "cnt": "count", "len": "length",
    "sz": "size", "pos": "position", "off": "offset", "cap": "capacity", "init": "initialize", "deinit": "deinitialize", "alloc": "allocate",
    "dealloc": "deallocate", "del": "delete", "rm": "remove", "impl": "implementation", "iface": "interface", "abs": "abstract",
    "decl": "declaration", "param": "parameter", "arg": "argument", "attr": "attribute", "prop": "property", "ret": "return", "src": "source",
    "dst": "destination", "tgt": "target", "orig": "original", "prev": "previous", "cur": "current", "tmp": "temporary", "temp": "temporary",
    "conn": "connection", "sess": "session", "sock": "socket", "addr": "address", "url": "uniform", "srv": "server", "cli": "client",
    "svc": "service", "ep": "endpoint", "mgr": "manager", "ctrl": "controller", "hdlr": "handler", "sched": "scheduler", "disp": "dispatcher",
    "reg": "registry", "chan": "channel", "sem": "semaphore", "mtx": "mutex", "wg": "waitgroup", "sig": "signal", "evt": "event",
    "sub": "subscriber", "pub": "publisher", "spec": "specification", "mock": "mock", "stub": "stub", "assert": "assertion", "log": "logging",
    "lvl": "level", "dbg": "debug", "wrn": "warning", "inf": "info", "ts": "timestamp", "dur": "duration", "ttl": "timetolive", "ver": "version",
    "ns": "namespace", "pkg": "package", "mod": "module", "lib": "library", "dep": "dependency", "ref": "reference", "ptr": "pointer",
    "obj": "object", "doc": "document", "cmd": "command", "ops": "operations", "util": "utility", "hlp": "helper", "ext": "extension",
}


def code_tokens(x: Column) -> Column:
    """Words of an identifier in lower case, then what its abbreviations stand for."""
    spaced = F.regexp_replace(x, r"(?<=[a-z])(?=[A-Z])", " ")
    words = F.transform(F.split(spaced, r"[./_\- (),:]"), lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z0-9]", "")))
    words = F.filter(words, lambda w: w != "")
    known = F.create_map(*(F.lit(v) for kv in ABBREVIATIONS.items() for v in kv))
    return F.concat(words, F.filter(F.transform(words, lambda w: F.try_element_at(known, w)), lambda w: w.isNotNull()))


# Words of decorators that say nothing.
DECORATOR_STOPWORDS = ("get", "set", "new", "class", "method", "function", "value", "type", "param", "return", "public", "private", "for", "if", "the", "and", "or", "not", "with", "from", "app", "router")


def decorator_tokens(x: Column) -> Column:
    """Words of a decorator: without @, #[ ] and arguments, two letters or more, no stop words."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^@?(?:#\[)?", ""), r"\(.*$", ""), r"\]$", "")
    spaced = F.regexp_replace(name, r"(?<=[a-z])(?=[A-Z])", " ")
    words = F.split(F.lower(spaced), r"[._\-:/ ]+")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*DECORATOR_STOPWORDS))


# -- routes, urls and times


def url_path(url: Column) -> Column:
    """From the third slash to the question mark; empty for relative and empty ones."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^/]*/[^/]*/[^/]*(/[^?]*)", 1)


def duration_ns(start: Column, end: Column) -> Column:
    """end - start of texts, not below 0; 0 where one is missing or no number."""
    return F.greatest(F.coalesce(F.try_subtract(end.try_cast("bigint"), start.try_cast("bigint")), F.lit(0)), F.lit(0))


def route_canonical(path: Column) -> Column:
    """:x at the start of a segment, {x}, <x> and ${x} become {}."""
    out = F.regexp_replace(F.coalesce(path, F.lit("")), r"\$\{[^}/]*\}?|\{[^}/]*\}?|<[^>/]*>?", "{}")
    return F.regexp_replace(out, r"(^|/):[A-Za-z0-9_]+", "$1{}")


# -- grades


def hop_risk(hop: Column) -> Column:
    return F.when(hop == 1, "CRITICAL").when(hop == 2, "HIGH").when(hop == 3, "MEDIUM").otherwise("LOW")


def confidence_band(x: Column) -> Column:
    return F.when(x >= 0.7, "high").when(x >= 0.45, "medium").when(x >= 0.25, "speculative").otherwise("")


def minhash_hex(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def minhash_unhex(text: Column) -> Column:
    n = (F.length(text) / 8).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substr(text, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def signature_jaccard(a: Column, b: Column) -> Column:
    """The share of places at which two signatures are equal."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.try_divide(same.cast("double"), F.size(a).cast("double"))


def diff_range(text: Column) -> Column:
    """start and end of a hunk's "start,count"; without a count it is one line, with 0 the end is the start."""
    start = F.regexp_extract(text, r"^(\d+)", 1).try_cast("int")
    count = F.coalesce(F.regexp_extract(text, r",(\d+)", 1).try_cast("int"), F.lit(1))
    return F.struct(F.coalesce(start, F.lit(0)).alias("start"), F.greatest(F.coalesce(start, F.lit(0)) + count - 1, F.coalesce(start, F.lit(0))).alias("end"))


# -- fully qualified names


def module_name(project: Column, rel_path: Column) -> Column:
    """project.dir.file of a source file, without its extension; __init__ and index files stand for their folder."""
    stem = F.regexp_replace(rel_path, r"\.[^./]*$", "")
    stem = F.regexp_replace(stem, r"(?:^|/)(?:__init__|index)$", "")
    return F.concat_ws(".", project, F.when(stem != "", F.replace(stem, F.lit("/"), F.lit("."))))


def qualified_name(project: Column, rel_path: Column, name: Column) -> Column:
    return F.concat_ws(".", module_name(project, rel_path), F.when(name != "", name))


def folder_name(project: Column, folder: Column) -> Column:
    return F.concat_ws(".", project, F.when(folder.isNotNull() & ~folder.isin("", "."), F.replace(folder, F.lit("/"), F.lit("."))))


def project_name(path: Column) -> Column:
    """A root path as a name: separators and odd characters become single dashes."""
    return F.regexp_replace(F.regexp_replace(path, r"[^A-Za-z0-9._]+", "-"), r"^-+|-+$", "")
