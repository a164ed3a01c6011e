"""Source trees as tables of files."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arch import language

# Folders that are never part of a project's own sources.
SKIPPED_FOLDERS = (".git", ".hg", ".svn", "node_modules", "vendor", "target", "build", "dist", "__pycache__", ".venv", "venv", ".idea", ".vscode", ".cache")


def gitignore_regex(pattern: str) -> tuple[str, bool] | None:
    """A regular expression over relative paths, and whether the line takes back; None for blanks and comments."""
    line = pattern.rstrip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    line = line[1:] if line.startswith("\\") else line
    only_folders, line = line.endswith("/"), line.rstrip("/")
    anchored = "/" in line
    out, i = "", 0
    line = line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            out, i = out + "[" + line[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/.*$" if only_folders else "(?:/.*)?$"), back


def ignored(path: Column, patterns: list[str]) -> Column:
    """Of the lines that match, the last decides."""
    out = F.lit(False)
    for parsed in filter(None, map(gitignore_regex, patterns)):
        out = F.when(path.rlike(parsed[0]), not parsed[1]).otherwise(out)
    return out


def source_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, content: bool = False) -> DataFrame:
    """file_path, language, size, mtime_ns (and content) of the files under root that are not ignored."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    path = F.regexp_replace("path", "^.*?" + re.escape(base.split(":")[-1].lstrip("/")) + "/", "").alias("file_path")
    own = df.select(path, F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), *([F.decode("content", "UTF-8").alias("content")] if content else []))
    skipped = F.col("file_path").rlike("(?:^|/)(?:" + "|".join(map(re.escape, SKIPPED_FOLDERS)) + ")/")
    return own.filter(~skipped & ~ignored(F.col("file_path"), ignore or [])).withColumn("language", language(F.col("file_path")))


def file_nodes(files: DataFrame, project: str) -> DataFrame:
    """File nodes without ids: project, label, name, qualified_name, file_path."""
    return files.select(F.lit(project).alias("project"), F.lit("File").alias("label"), F.element_at(F.split("file_path", "/"), -1).alias("name"), F.concat(F.lit(project + "."), F.replace("file_path", F.lit("/"), F.lit("."))).alias("qualified_name"), "file_path")


def git_context(path: str) -> dict[str, str]:
    """root, branch, detached, remote of a working copy; empty values where git knows none."""

    def ask(*args: str) -> str:
        done = subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, check=False)
        return done.stdout.strip() if done.returncode == 0 else ""

    branch = ask("rev-parse", "--abbrev-ref", "HEAD")
    return {"root": ask("rev-parse", "--show-toplevel"), "branch": "" if branch == "HEAD" else branch, "detached": str(branch == "HEAD").lower(), "remote": ask("remote", "get-url", "origin")}
