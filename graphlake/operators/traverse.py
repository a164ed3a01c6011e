"""Walks over edges: reachability, traces, impact, depth, dead code, transitive loop depth."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from .lineage import cut


def reach(seeds: DataFrame, edges: DataFrame, least: int, most: int | None) -> DataFrame:
    """seed, node, hop: nodes at a smallest distance of least to most edges from each seed, which is not itself one.

    seeds: column seed; edges: columns _from, _to, in which an edge may be listed several times; most None: any distance.
    One step is a lazy plan. Longer walks run step by step until nothing is new: a step joins the nodes that the one
    before found, so no work is done on edges that no walk comes to, and writes them only; what was found before stays
    where it is.
    """
    step = edges.select("_from", "_to").filter("_from <> _to")

    def onwards(frontier: DataFrame) -> DataFrame:
        return frontier.join(step, F.col("node") == F.col("_from")).select("seed", F.col("_to").alias("node")).distinct()

    start = seeds.select("seed", F.col("seed").alias("node")).distinct()
    if most == 1:
        return onwards(start).filter("node <> seed").withColumn("hop", F.lit(1)).filter(F.col("hop") >= least)
    layers = [cut(start)]
    while most is None or len(layers) <= most:
        known = reduce(DataFrame.union, layers)
        layers.append(cut(onwards(layers[-1]).join(known, ["seed", "node"], "left_anti")))
        if layers[-1].isEmpty():
            break
    found = [x.withColumn("hop", F.lit(hop)) for hop, x in enumerate(layers) if hop >= max(least, 1)]
    return reduce(DataFrame.union, found) if found else start.limit(0).withColumn("hop", F.lit(0))


def directed(edges: DataFrame, direction: str, types: list[str] | None = None) -> DataFrame:
    """_from, _to of the edges as they are walked: outbound, inbound or both."""
    edges = edges if types is None else edges.filter(F.col("type").isin(types))
    out = edges.select(F.col("source_id").alias("_from"), F.col("target_id").alias("_to"))
    back = edges.select(F.col("target_id").alias("_from"), F.col("source_id").alias("_to"))
    return {"outbound": out, "inbound": back, "both": out.unionByName(back)}[direction]


def bfs(nodes: DataFrame, edges: DataFrame, start: int | list[int], direction: str = "outbound", types: list[str] | None = None, depth: int | None = 3, limit: int | None = None) -> DataFrame:
    """The nodes reached, each once with its smallest hop, in canonical order; the start is none of them. depth None: all."""
    starts = start if isinstance(start, list) else [start]
    seeds = nodes.filter(F.col("id").isin(starts)).select(F.col("id").alias("seed"))
    hops = reach(seeds, directed(edges, direction, types), 1, depth).groupBy(F.col("node").alias("id")).agg(F.min("hop").alias("hop"))
    out = nodes.join(hops, "id").filter(~F.col("id").isin(starts)).orderBy("hop", "file_path", "start_line", "qualified_name", "id")
    return out if limit is None else out.limit(limit)


def bfs_edges(edges: DataFrame, visited: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The edges between visited nodes (column id)."""
    edges = edges if types is None else edges.filter(F.col("type").isin(types))
    ids = visited.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


#: Edge types that each mode of a trace follows.
MODES = {
    "calls": ["CALLS"],
    "data_flow": ["CALLS", "DATA_FLOWS"],
    "cross_service": ["CALLS", "HTTP_CALLS", "ASYNC_CALLS", "DATA_FLOWS", "CROSS_HTTP_CALLS", "CROSS_ASYNC_CALLS", "CROSS_CHANNEL", "CROSS_GRPC_CALLS", "CROSS_GRAPHQL_CALLS", "CROSS_TRPC_CALLS"],
}


def trace(nodes: DataFrame, edges: DataFrame, start: int, direction: str = "outbound", mode: str | list[str] = "calls", depth: int = 3) -> DataFrame:
    """A walk with a risk label for each hop; direction both walks each way by itself."""
    types = MODES[mode] if isinstance(mode, str) else mode
    ways = ["inbound", "outbound"] if direction == "both" else [direction]
    parts = [bfs(nodes, edges, start, w, types, depth).withColumn("direction", F.lit(w)) for w in ways]
    return reduce(DataFrame.unionByName, parts).withColumn("risk", scalar.hop_risk(F.col("hop")))


def impact_summary(visits: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of each risk over the smallest hop of each id, total, and whether a call crosses services."""
    hops = visits.groupBy("id").agg(F.min("hop").alias("hop"))
    risk = scalar.hop_risk(F.col("hop"))
    counts = [F.count(F.when(risk == r, 1)).alias(r.lower()) for r in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]
    crossing = edges.agg(F.coalesce(F.bool_or(F.col("type").isin("HTTP_CALLS", "ASYNC_CALLS")), F.lit(False)).alias("has_cross_service"))
    return hops.agg(*counts, F.count("*").alias("total")).crossJoin(crossing)  # one row each


def changed_symbols(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Nodes whose lines meet a hunk (file_path, start, end) of their file; modules and packages are not meant."""
    own = nodes.filter(~F.col("label").isin("Module", "Package", "File", "Folder", "Project"))
    h = hunks.select(F.col("file_path"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    return own.join(h, "file_path").filter("start_line <= _b and end_line >= _a").drop("_a", "_b").dropDuplicates(["id"])


def impact(nodes: DataFrame, edges: DataFrame, hunks: DataFrame, depth: int = 4, types: list[str] | None = None) -> DataFrame:
    """id, hop of everything that reaches a changed symbol."""
    seeds = changed_symbols(nodes, hunks).select(F.col("id").alias("seed"))
    return reach(seeds, directed(edges, "inbound", types or MODES["calls"]), 1, depth).groupBy(F.col("node").alias("id")).agg(F.min("hop").alias("hop"))


def call_depth(nodes: DataFrame, edges: DataFrame, roots: list[str] | None = None, types: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """id, hop: distance from the entry nodes (labels roots), or from nodes nothing leads to where there are none. depth None: any."""
    walk = directed(edges, "outbound", types)
    seeds = nodes.filter(F.col("label").isin(roots or ["Route", "File", "Module", "Package"])).select("id")
    if seeds.isEmpty():
        seeds = nodes.select("id").join(walk.select(F.col("_to").alias("id")).distinct(), "id", "left_anti")
    layers = [cut(seeds.select("id").distinct())]
    while depth is None or len(layers) <= depth:
        new = layers[-1].join(walk, F.col("id") == F.col("_from")).select(F.col("_to").alias("id")).distinct()
        layers.append(cut(new.join(reduce(DataFrame.union, layers), "id", "left_anti")))
        if layers[-1].isEmpty():
            break
    return reduce(DataFrame.union, [x.withColumn("hop", F.lit(hop)) for hop, x in enumerate(layers)])


def bfs_sql(spark, nodes: DataFrame, edges: DataFrame, start: int, types: list[str], depth: int) -> DataFrame:
    """id, hop of the nodes that a recursive SQL query reaches along edges of the types; the start is none of them.

    For small graphs: the query walks every path, so depth must be given.
    """
    names = {"n": nodes.select("id"), "e": edges.filter(F.col("type").isin(types)).select("source_id", "target_id").distinct()}
    text = """
        WITH RECURSIVE w(id, hop) AS (
            SELECT id, 0 FROM {n} WHERE id = {start} UNION ALL
            SELECT e.target_id, w.hop + 1 FROM w JOIN {e} e ON e.source_id = w.id WHERE w.hop < {depth})
        SELECT id, CAST(min(hop) AS INT) AS hop FROM w WHERE id <> {start} GROUP BY id"""
    return spark.sql(text, start=start, depth=depth, **names)


def degrees(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """id, in_degree, out_degree of every node: one pass over the edges."""
    edges = edges if types is None else edges.filter(F.col("type").isin(types))
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    sums = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return nodes.select("id").join(sums, "id", "left").na.fill(0, ["in_degree", "out_degree"])


#: Edge types that count as use in searches.
SEARCH_TYPES = ["CALLS", "USAGE", "INHERITS", "IMPLEMENTS"]


def code_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with in_calls, in_usage and status: structural, test, entry, exported, dead, single or normal."""

    def flag(name: str):
        return F.coalesce(F.get_json_object("properties", f"$.{name}") == "true", F.lit(False))

    calls = edges.filter(F.col("type").isin("CALLS", "USAGE")).groupBy(F.col("target_id").alias("id")).agg(
        F.count(F.when(F.col("type") == "CALLS", 1)).alias("in_calls"), F.count(F.when(F.col("type") == "USAGE", 1)).alias("in_usage")
    )
    out = nodes.join(calls, "id", "left").na.fill(0, ["in_calls", "in_usage"])
    status = (
        F.when(~F.col("label").isin("Function", "Method"), "structural")
        .when(flag("is_test") | scalar.is_test_file(F.col("file_path")), "test")
        .when(flag("is_entry_point") | flag("is_route"), "entry")
        .when(flag("is_exported"), "exported")
        .when((F.col("in_calls") == 0) & (F.col("in_usage") == 0), "dead")
        .when(F.col("in_calls") == 1, "single")
        .otherwise("normal")
    )
    return out.withColumn("status", status)


def dead_code(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Nodes nothing calls; entry points are not meant."""
    called = edges.filter(F.col("type").isin(types or ["CALLS"])).select(F.col("target_id").alias("id")).distinct()
    entry = F.coalesce(F.get_json_object("properties", "$.is_entry_point") == "true", F.lit(False))
    return nodes.filter(~entry).join(called, "id", "left_anti")


#: Connected functions of up to so many are done in one task, larger groups level by level; so many members may a cycle have.
TOGETHER, CYCLE_MEMBERS = 100_000, 100_000


def loop_depths(nodes: DataFrame, edges: DataFrame, together: int = TOGETHER) -> DataFrame:
    """id, tld, recursive: own loop depth plus the deepest callee's; calls along a cycle count once and mark it.

    nodes: id, qualified_name, loop_depth. A function is done after those it calls. Functions that call each other in a
    cycle are walked together, depth first in order of their names: a call back to one that is being walked counts
    nothing and marks both. Connected groups of more than `together` functions are done level by level over all tasks;
    more than CYCLE_MEMBERS on one cycle raise ValueError.
    """
    from .communities import components

    own = nodes.select("id", "qualified_name", F.coalesce("loop_depth", F.lit(0)).cast("int").alias("loop_depth"))
    calls = edges.filter(F.col("type") == "CALLS").select("source_id", "target_id").distinct()
    calls = calls.join(own.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(own.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    calls = cut(calls.select("source_id", "target_id"))
    parts = components(own.select("id"), calls.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    own = cut(own.join(parts, "id").join(sizes, "component"))
    callees = calls.groupBy(F.col("source_id").alias("id")).agg(F.collect_list("target_id").alias("callees"))
    small = own.filter((F.col("size") > 1) & (F.col("size") <= together)).join(callees, "id", "left").withColumn("callees", F.coalesce("callees", F.array().cast("array<bigint>")))
    loops = calls.filter("source_id = target_id").select(F.col("source_id").alias("id")).withColumn("recursive", F.lit(True))
    single = own.filter("size = 1").join(loops, "id", "left").select("id", F.col("loop_depth").alias("tld"), F.coalesce("recursive", F.lit(False)).alias("recursive"))
    done = single.unionByName(small.groupBy("component").applyInPandas(_walk_component, "id bigint, tld int, recursive boolean"))
    large = own.filter((F.col("size") > 1) & (F.col("size") > together))
    return done if large.isEmpty() else done.unionByName(_by_levels(large.select("id", "qualified_name", "loop_depth"), calls))


def _walk_component(part: pd.DataFrame) -> pd.DataFrame:
    """Cycles by depth-first search with low links, which come in an order in which callees are done before callers."""
    calls = {i: list(c) for i, c in zip(part.id, part.callees)}
    name, own = dict(zip(part.id, part.qualified_name)), dict(zip(part.id, part.loop_depth))
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    held: list[int] = []
    waiting: set[int] = set()
    tld: dict[int, int] = {}
    looping: set[int] = set()
    for root in part.id:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        held.append(root)
        waiting.add(root)
        stack = [(root, iter(calls[root]))]
        while stack:
            at, rest = stack[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    held.append(to)
                    waiting.add(to)
                    stack.append((to, iter(calls[to])))
                    break
                if to in waiting:
                    low[at] = min(low[at], number[to])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[at])
                if low[at] == number[at]:
                    members = set()
                    while at not in members:
                        members.add(held.pop())
                    waiting -= members
                    below = {i: max([tld[c] for c in calls[i] if c in tld], default=0) for i in members}
                    found, marked = _walk_cycle(members, name, own, {i: [c for c in calls[i] if c in members] for i in members}, below)
                    tld |= found
                    looping |= marked
    return pd.DataFrame({"id": part.id, "tld": [tld[i] for i in part.id], "recursive": [i in looping for i in part.id]})


def _walk_cycle(members, name: dict, own: dict, calls: dict, below: dict) -> tuple[dict[int, int], set[int]]:
    """Depths of functions that call each other, and those that call back. below: the deepest that each calls outside."""
    done: dict[int, int] = {}
    looping: set[int] = set()
    best = dict(below)
    for root in sorted(members, key=lambda i: (name[i], i)):
        if root in done:
            continue
        stack, active = [(root, iter(sorted(calls[root])))], {root}
        while stack:
            at, rest = stack[-1]
            for to in rest:
                if to in active:
                    looping |= {at, to}
                elif to in done:
                    best[at] = max(best[at], done[to])
                else:
                    stack.append((to, iter(sorted(calls[to]))))
                    active.add(to)
                    break
            else:
                stack.pop()
                active.discard(at)
                done[at] = int(own[at] + best[at])
                if stack:
                    best[stack[-1][0]] = max(best[stack[-1][0]], done[at])
    return done, looping


def _walk_unit(part: pd.DataFrame) -> pd.DataFrame:
    calls = dict(zip(part.id, part.callees))
    found, looping = _walk_cycle(set(part.id), dict(zip(part.id, part.qualified_name)), dict(zip(part.id, part.loop_depth)), calls, dict(zip(part.id, part.below)))
    return pd.DataFrame({"id": part.id, "tld": [found[i] for i in part.id], "recursive": [i in looping for i in part.id]})


def _trimmed(calls: DataFrame) -> DataFrame:
    """Without functions that have no caller or no callee, until all that are left have both."""
    while True:
        here = calls.select(F.col("source_id").alias("id")).distinct().join(calls.select(F.col("target_id").alias("id")).distinct(), "id", "left_semi")
        left = calls.join(here.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(here.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        left = cut(left.select("source_id", "target_id"))
        if left.count() == calls.count():
            return left
        calls = left


def cycles(calls: DataFrame) -> DataFrame:
    """id, cycle: functions that call each other, with the smallest id among them. calls: source_id, target_id.

    Each function gets the smallest id that reaches it and the smallest that it reaches. Where both are the same id, it
    lies on a cycle with it; all others can only be on a cycle with such as have the same two ids, and are looked at again.
    """
    core, found = _trimmed(cut(calls.filter("source_id <> target_id").select("source_id", "target_id").distinct())), []
    while not core.isEmpty():
        marks = ids = cut(core.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct())
        for a, b, mark in (("source_id", "target_id", "by"), ("target_id", "source_id", "to")):
            least, state = cut(ids.withColumn("least", F.col("id"))), None
            while True:
                near = core.select(F.col(a).alias("id"), F.col(b).alias("other")).join(least, "id").groupBy(F.col("other").alias("id")).agg(F.min("least").alias("near"))
                least = cut(least.join(near, "id", "left").select("id", F.least("least", F.coalesce("near", "least")).alias("least")))
                now = least.agg(F.sum(F.col("least").cast("decimal(38,0)"))).head()[0]
                if now == state:
                    break
                state = now
            marks = marks.join(least.withColumnRenamed("least", mark), "id")
        marks = cut(marks)
        own = marks.filter("`by` = `to`").select("id", F.col("by").alias("cycle"))
        several = own.groupBy("cycle").agg(F.count("*").alias("n")).filter("n > 1")
        found.append(cut(own.join(several.select("cycle"), "cycle", "left_semi").select("id", "cycle")))
        rest = marks.filter("`by` <> `to`")
        a, b = (rest.select(F.col("id").alias(end), F.struct("by", "to").alias(f"{end}_marks")) for end in ("source_id", "target_id"))
        core = _trimmed(cut(core.join(a, "source_id").join(b, "target_id").filter("source_id_marks = target_id_marks").select("source_id", "target_id")))
    return reduce(DataFrame.union, found) if found else calls.select(F.col("source_id").alias("id"), F.col("source_id").alias("cycle")).limit(0)


def _by_levels(own: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions (cycles as one) are done, over all tasks, when all that they call are done."""
    calls = cut(calls.join(own.select(F.col("id").alias("source_id")), "source_id", "left_semi"))
    of_cycle = cut(cycles(calls))
    large = of_cycle.groupBy("cycle").count().filter(F.col("count") > CYCLE_MEMBERS).head()
    if large:
        raise ValueError(f"{large['count']} functions call each other around {large['cycle']}")
    unit = cut(own.join(of_cycle, "id", "left").withColumn("unit", F.coalesce("cycle", "id")))
    loops = calls.filter("source_id = target_id").select(F.col("source_id").alias("id")).withColumn("loop", F.lit(True))
    across = calls.join(unit.select(F.col("id").alias("source_id"), F.col("unit").alias("from")), "source_id").join(unit.select(F.col("id").alias("target_id"), F.col("unit").alias("to")), "target_id")
    inside = across.filter("`from` = `to`").groupBy(F.col("source_id").alias("id")).agg(F.collect_list("target_id").alias("callees"))
    waits = cut(across.filter("`from` <> `to`").select("source_id", "target_id", "from", "to"))
    left, done = cut(unit.select("unit").distinct()), []
    while True:
        blocked = waits.join(left.withColumnRenamed("unit", "to"), "to", "left_semi").select(F.col("from").alias("unit")).distinct()
        ready = cut(left.join(blocked, "unit", "left_anti"))
        if ready.isEmpty():
            break
        here = unit.join(ready, "unit", "left_semi").withColumn("below", F.lit(0))
        if done:
            known = reduce(DataFrame.union, done).select(F.col("id").alias("target_id"), "tld")
            deepest = waits.join(known, "target_id").groupBy(F.col("source_id").alias("id")).agg(F.max("tld").alias("deepest"))
            here = here.join(deepest, "id", "left").withColumn("below", F.coalesce("deepest", F.lit(0)))
        alone = here.filter("cycle is null").join(loops, "id", "left").select("id", (F.col("loop_depth") + F.col("below")).alias("tld"), F.coalesce("loop", F.lit(False)).alias("recursive"))
        walked = here.filter("cycle is not null").join(inside, "id").groupBy("unit").applyInPandas(_walk_unit, "id bigint, tld int, recursive boolean")
        done.append(cut(alone.unionByName(walked)))
        left = cut(left.join(ready, "unit", "left_anti"))
    return reduce(DataFrame.union, done)
