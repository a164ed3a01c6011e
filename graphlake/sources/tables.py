"""The graph view over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import EdgeTable, NodeTable, PropertyGraph

#: Ids of different kinds do not meet: kind * SPAN + key.
SPAN = 10**10
KINDS = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "User": 7, "EventType": 8, "Document": 9, "Page": 10}
#: Event types have no key; theirs is the place in this list.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def node_id(kind: str, key: Column) -> Column:
    return F.lit(KINDS[kind] * SPAN) + key.cast("bigint")


def _nodes(load: Callable[[], DataFrame], kind: str, key: str, name: Column) -> NodeTable:
    def opened() -> DataFrame:
        df, qualified = load(), F.concat(F.lit(f"bench.{kind}."), F.col(key).cast("string"))
        envelope = [node_id(kind, F.col(key)).alias("id"), name.alias("name"), qualified.alias("qualified_name")]
        return df.select(*envelope, *(c for c in df.columns if c not in ("id", "name", "qualified_name")))

    return NodeTable(kind, opened)


def bench_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Tables are opened when a query first names a label or type of theirs, each once."""

    @cache
    def opened(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def t(name: str) -> Callable[[], DataFrame]:
        return lambda: opened(name)

    event_key = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).cast("bigint")
    nodes = (
        _nodes(t("region"), "Region", "r_regionkey", F.col("r_name")),
        _nodes(t("nation"), "Nation", "n_nationkey", F.col("n_name")),
        _nodes(t("customer"), "Customer", "c_custkey", F.col("c_name")),
        _nodes(t("supplier"), "Supplier", "s_suppkey", F.col("s_name")),
        _nodes(t("part"), "Part", "p_partkey", F.col("p_name")),
        _nodes(t("orders"), "Order", "o_orderkey", F.col("o_orderkey").cast("string")),
        _nodes(lambda: opened("events").select("user_id").distinct(), "User", "user_id", F.concat(F.lit("user"), F.col("user_id").cast("string"))),
        _nodes(lambda: opened("events").select("event_type").distinct().select("event_type", event_key.alias("event_key")), "EventType", "event_key", F.col("event_type")),
        _nodes(t("documents"), "Document", "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"))),
        _nodes(t("pages"), "Page", "page_id", F.col("url")),
    )

    def e(kind: str, source: str, target: str, load: Callable[[], DataFrame], a: Column, b: Column, distinct: bool = False) -> EdgeTable:
        return EdgeTable(kind, lambda: load().select(node_id(source, a).alias("source_id"), node_id(target, b).alias("target_id")), source, target, distinct)

    c = F.col
    edges = (
        e("IN_REGION", "Nation", "Region", t("nation"), c("n_nationkey"), c("n_regionkey")),
        e("IN_NATION", "Customer", "Nation", t("customer"), c("c_custkey"), c("c_nationkey")),
        e("IN_NATION", "Supplier", "Nation", t("supplier"), c("s_suppkey"), c("s_nationkey")),
        e("PLACED", "Customer", "Order", t("orders"), c("o_custkey"), c("o_orderkey")),
        e("CONTAINS", "Order", "Part", t("lineitem"), c("l_orderkey"), c("l_partkey"), distinct=True),
        e("SUPPLIED_BY", "Part", "Supplier", t("lineitem"), c("l_partkey"), c("l_suppkey"), distinct=True),
        e("DID", "User", "EventType", t("events"), c("user_id"), event_key, distinct=True),
    )
    return PropertyGraph(project="bench", node_tables=nodes, edge_tables=edges, spark=spark)
