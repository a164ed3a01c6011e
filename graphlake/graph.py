"""Property graphs: node and edge tables, stored or mapped from relational tables.

A mapped table keeps its typed columns; a query reads just the columns it names, so filters and column pruning reach
the files. A stored graph holds its properties as JSON text, read by path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EDGE, ENVELOPE, NODE, NODE_TYPES, check


@dataclass(frozen=True)
class NodeTable:
    """One label's nodes: the table has the envelope's id and name, and any typed property columns.

    source: the table, or what opens it when a query first asks for the label.
    """

    label: str
    source: DataFrame | Callable[[], DataFrame]

    @cached_property
    def df(self) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source()

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in ENVELOPE]


@dataclass(frozen=True)
class EdgeTable:
    """One type's edges: the table has source_id and target_id, and any typed property columns.

    rows: the table, or what opens it. repeated: it may list an edge several times, which counts once.
    """

    type: str
    rows: DataFrame | Callable[[], DataFrame]
    source: str
    target: str
    repeated: bool = False

    @cached_property
    def listed(self) -> DataFrame:
        """The edges as they are listed, for walks, which count a node once anyhow."""
        return self.rows if isinstance(self.rows, DataFrame) else self.rows()

    @cached_property
    def df(self) -> DataFrame:
        return self.listed.distinct() if self.repeated else self.listed

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("source_id", "target_id", "id")]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class PropertyGraph:
    """Either typed tables (node_tables, edge_tables) or stored ones (stored_nodes, stored_edges)."""

    project: str = "default"
    node_tables: tuple[NodeTable, ...] = ()
    edge_tables: tuple[EdgeTable, ...] = ()
    stored_nodes: DataFrame | None = None
    stored_edges: DataFrame | None = None
    spark: SparkSession | None = field(default=None, compare=False)

    @classmethod
    def stored(cls, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        check(nodes, NODE, "nodes")
        check(edges, EDGE, "edges")
        return cls(stored_nodes=nodes, stored_edges=edges, spark=nodes.sparkSession)

    @classmethod
    def read(cls, spark: SparkSession, path: str, project: str | None = None) -> PropertyGraph:
        """A graph as `write` leaves it: folders nodes and edges, partitioned by project and label or type."""
        nodes, edges = (spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges"))
        if project is not None:
            nodes, edges = (t.filter(F.col("project") == project) for t in (nodes, edges))
        return cls.stored(nodes.select(*NODE.fieldNames()), edges.select(*EDGE.fieldNames()))

    def write(self, path: str) -> None:
        self.nodes().write.mode("overwrite").partitionBy("project", "label").option("compression", "zstd").parquet(f"{path}/nodes")
        self.edges().write.mode("overwrite").partitionBy("project", "type").option("compression", "zstd").parquet(f"{path}/edges")

    # -- what the compiler asks for

    def labels(self) -> list[str] | None:
        """All labels, or None where only the data know."""
        return [t.label for t in self.node_tables] if self.stored_nodes is None else None

    def edge_ends(self, types: Iterable[str] | None) -> list[EdgeTable] | None:
        """The tables of the types, or None where only the data know."""
        if self.stored_edges is not None:
            return None
        return [t for t in self.edge_tables if types is None or t.type in types]

    def node_scan(self, labels: Iterable[str] | None, columns: Iterable[str]) -> DataFrame:
        """id, label and the asked columns of the nodes with these labels (None: all)."""
        labels, columns = (None if labels is None else list(labels)), [c for c in dict.fromkeys(columns) if c not in ("id", "label")]
        if self.stored_nodes is not None:
            df = self.stored_nodes if labels is None else self.stored_nodes.filter(F.col("label").isin(labels))
            return df.select("id", "label", *(self._stored(c, NODE.fieldNames()) for c in columns))
        tables = [t for t in self.node_tables if labels is None or t.label in labels]
        kinds = {c: self._kind([dict(t.df.dtypes) for t in tables], c) for c in columns}
        if not tables:
            return self.spark.createDataFrame([], ", ".join(["id bigint", "label string", *(f"`{c}` {NODE_TYPES.get(c, 'string')}" for c in columns)]))
        return _union([t.df.select("id", F.lit(t.label).alias("label"), *(self._typed(t.df, c, kinds[c], t.label, t.properties) for c in columns)) for t in tables])

    def edge_scan(self, types: Iterable[str] | None, columns: Iterable[str], repeated: bool = False) -> DataFrame:
        """source_id, target_id, type and the asked columns of the edges with these types (None: all).

        repeated: an edge may come several times, where that makes no difference and saves its table a shuffle.
        """
        types, columns = (None if types is None else list(types)), [c for c in dict.fromkeys(columns) if c not in ("source_id", "target_id", "type")]
        if self.stored_edges is not None:
            df = self.stored_edges if types is None else self.stored_edges.filter(F.col("type").isin(types))
            return df.select("source_id", "target_id", "type", *(self._stored(c, EDGE.fieldNames()) for c in columns))
        tables = [t for t in self.edge_tables if types is None or t.type in types]
        kinds = {c: self._kind([dict(t.df.dtypes) for t in tables], c) for c in columns}
        if not tables:
            return self.spark.createDataFrame([], ", ".join(["source_id bigint", "target_id bigint", "type string", *(f"`{c}` string" for c in columns)]))
        return _union([(t.listed if repeated else t.df).select("source_id", "target_id", F.lit(t.type).alias("type"), *(self._typed(t.df, c, kinds[c], t.type, t.properties) for c in columns)) for t in tables])

    def nodes(self) -> DataFrame:
        """All nodes in the envelope."""
        return self.node_scan(None, ENVELOPE).select(*(F.col(f.name).cast(f.dataType) for f in NODE))

    def edges(self) -> DataFrame:
        return self.edge_scan(None, EDGE.fieldNames()).select(*(F.col(f.name).cast(f.dataType) for f in EDGE))

    @staticmethod
    def _stored(c: str, known: list[str]) -> Column:
        return F.col(c) if c in known else F.get_json_object("properties", f"$.{c}").alias(c)

    @staticmethod
    def _kind(types: list[dict[str, str]], c: str) -> str:
        if c in NODE_TYPES and c != "properties":
            return NODE_TYPES[c]
        found = {t[c] for t in types if c in t}
        numbers = {"int", "bigint", "double", "float", "smallint", "tinyint"}
        return next(iter(found)) if len(found) == 1 else "double" if found and found <= numbers else "string"

    def _typed(self, df: DataFrame, c: str, kind: str, label: str, properties: list[str]) -> Column:
        if c in df.columns:
            return F.col(c).cast(kind).alias(c)
        if c == "properties":
            return (F.to_json(F.struct(*properties)) if properties else F.lit("{}")).alias(c)
        if c == "project":
            return F.lit(self.project).alias(c)
        if c == "name" and "id" in df.columns:
            return F.col("id").cast("string").alias(c)
        if c == "qualified_name":
            return F.concat(F.lit(f"{self.project}.{label}."), F.coalesce("id", F.lit(0)).cast("string") if "id" in df.columns else F.lit("")).alias(c)
        return F.lit(None).cast(kind).alias(c)
