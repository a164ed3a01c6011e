"""The tools of a code-graph server, as methods over stored graphs.

A store is a folder of graph generations (nodes, edges) beside tables of files, summaries and spans. Every tool returns a
table, or a dictionary of tables; nothing but what a caller collects reaches the driver.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .operators import arch, dml, search, traverse
from .operators.incremental import Generations
from .plans.compiler import run
from .schema import EDGE, NODE
from .sources import texts


class Tools:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Generations(spark, f"{root.rstrip('/')}/graph")
        self.side = Generations(spark, f"{root.rstrip('/')}/side")

    # -- what is stored

    def _graph(self) -> tuple[DataFrame, DataFrame]:
        if not self.store.latest():
            return self.spark.createDataFrame([], NODE), self.spark.createDataFrame([], EDGE)
        at = self.store.latest()
        return self.store.read("nodes", at), self.store.read("edges", at)

    def _publish(self, nodes: DataFrame, edges: DataFrame) -> int:
        return self.store.publish({"nodes": nodes, "edges": edges}, self.store.latest())

    def _side(self, name: str, schema: str) -> DataFrame:
        return self.side.read(name) if self.side.latest() else self.spark.createDataFrame([], schema)

    def index_repository(self, nodes: DataFrame, edges: DataFrame) -> int:
        """Stores a project's graph in place of what was stored of its projects; returns the generation."""
        old_nodes, old_edges = self._graph()
        named = nodes.select("project").distinct()
        kept = old_nodes.join(named, "project", "left_anti").select(*NODE.fieldNames())
        return self._publish(kept.unionByName(nodes.select(*NODE.fieldNames())), old_edges.join(named, "project", "left_anti").select(*EDGE.fieldNames()).unionByName(dml.merge_edges(edges.select(*EDGE.fieldNames()))))

    def list_projects(self) -> DataFrame:
        return dml.list_projects(*self._graph())

    def delete_project(self, project: str) -> int:
        nodes, edges = dml.delete_nodes(*self._graph(), F.col("project") == project)
        return self._publish(nodes, edges.filter(F.col("project") != project))

    def index_status(self, project: str, expected: int | None = None) -> DataFrame:
        """project, nodes, edges, plausible: is what is stored at least half of what was meant to be?"""
        found = self.list_projects().filter(F.col("project") == project)
        told = F.lit(True) if expected is None else ~((F.lit(expected) > 50) & (F.col("nodes") < expected / 2))
        return found.withColumn("plausible", told)

    # -- questions

    def query_graph(self, text: str, max_rows: int | None = 100_000) -> DataFrame:
        return run(PropertyGraph.stored(*self._graph()), text, max_rows=max_rows)

    def search_graph(self, ask: search.Search | None = None, words: str = "", projects: list[str] | None = None, limit: int = 200, offset: int = 0) -> tuple[DataFrame, int]:
        """A page of nodes and the number of all: by words if there are any, else by structure."""
        nodes, edges = self._graph()
        wanted = projects if projects is not None else [r.project for r in nodes.select("project").distinct().collect()]  # a row for each project
        if words:
            return search.full_text_in(nodes, words, wanted, limit=limit, offset=offset)
        return search.structural_in(nodes, edges, wanted, replace(ask or search.Search(), limit=limit, offset=offset))

    def trace_path(self, name: str, direction: str = "both", mode: str = "calls", depth: int = 3) -> DataFrame:
        nodes, edges = self._graph()
        start = dml.by_suffix(nodes, name).orderBy("qualified_name", "id").head() or dml.lookup(nodes, "name", name).orderBy("qualified_name", "id").head()
        if start is None:
            raise ValueError(f"no node is called {name}")
        return traverse.trace(nodes, edges, start.id, direction, mode, depth)

    def detect_changes(self, diff: DataFrame, depth: int = 4) -> dict[str, DataFrame]:
        """symbols, impact and summary of a diff. diff: text."""
        nodes, edges = self._graph()
        hunks = texts.hunks(diff)
        hit = traverse.impact(nodes, edges, hunks, depth)
        return {"symbols": traverse.changed_symbols(nodes, hunks), "impact": hit, "summary": traverse.impact_summary(hit, traverse.bfs_edges(edges, hit))}

    def get_graph_schema(self) -> dict[str, DataFrame]:
        nodes, edges = self._graph()
        return {"labels": arch.label_schema(nodes), "types": arch.type_schema(edges), "patterns": arch.patterns(nodes, edges)}

    def get_architecture(self, aspects: list[str] | None = None, path: str = "") -> dict[str, DataFrame]:
        return arch.architecture(*self._graph(), aspects, path)

    def get_code_snippet(self, files: DataFrame, qualified_name: str) -> DataFrame:
        return search.snippet(files, self._graph()[0], qualified_name)

    def search_code(self, files: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
        return search.code_search(files, self._graph()[0], pattern, regex)

    # -- summaries and traces

    def manage_adr(self, project: str, mode: str = "get", text: str = "", section: str = "") -> DataFrame:
        """get, put or delete a project's summary, or get one section of it."""
        known = self._side("summaries", "project string, text string")
        if mode == "put":
            known = dml.summary_put(known, self.spark.createDataFrame([(project, text)], "project string, text string"))
        elif mode == "delete":
            known = dml.summary_delete(known, project)
        elif mode != "get":
            raise ValueError(f"summaries know get, put and delete, not {mode}")
        if mode != "get":
            self.side.publish({"summaries": known}, self.side.latest())
            known = self.side.read("summaries")
        return dml.summary_section(known, project, section) if section else known.filter(F.col("project") == project)

    def ingest_traces(self, spans: DataFrame) -> DataFrame:
        """method, path, n, p99 in nanoseconds of the spans' requests. spans: span, service."""
        return texts.p99_by(texts.span_facts(spans), ["method", "path"], "duration_ns")
