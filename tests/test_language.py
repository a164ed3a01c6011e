"""The query language over small stored graphs."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphlake.graph import EdgeTable, NodeTable, PropertyGraph
from graphlake.plans import compiler
from graphlake.plans.compiler import run
from graphlake.plans.parser import QueryError, parse
from graphlake.schema import EDGE, NODE
from graphlake.sources.tables import bench_graph


def make(spark, nodes, edges) -> PropertyGraph:
    """nodes: (id, label, name, file, start, end, properties); edges: (source, target, type, properties)."""
    n = [(i, "test", label, name, f"test.{name}", file, a, b, props) for i, label, name, file, a, b, props in nodes]
    e = [(k, "test", s, t, kind, props) for k, (s, t, kind, props) in enumerate(edges)]
    return PropertyGraph.stored(spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE))


@pytest.fixture(scope="module")
def g(spark):
    nodes = [
        (1, "Function", "HandleOrder", "handler.go", 10, 30, '{"complexity":3,"recursive":true,"kind":{"complexity":9}}'),
        (2, "Function", "ValidateOrder", "validate.go", 5, 15, "{}"),
        (3, "Function", "SubmitOrder", "submit.go", None, None, "{}"),
        (4, "Module", "main", None, None, None, "{}"),
        (5, "Function", "LogError", "log.go", None, None, "{}"),
    ]
    edges = [(1, 2, "CALLS", "{}"), (2, 3, "CALLS", "{}"), (1, 5, "CALLS", '{"confidence":0.85,"method":"POST"}'), (4, 1, "DEFINES", "{}")]
    return make(spark, nodes, edges)


def rows(g, text, **kw):
    return [tuple(r) for r in run(g, text, **kw).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (f:Function) RETURN COUNT(*) AS n", [(4,)]),
        ('MATCH (f:Function)-[:CALLS*1..3]->(g) WHERE f.name="HandleOrder" RETURN g.name ORDER BY g.name', [("LogError",), ("SubmitOrder",), ("ValidateOrder",)]),
        ('MATCH (f) WHERE f.name="LogError" OPTIONAL MATCH (f)-[:CALLS]->(g) RETURN f.name, g.name', [("LogError", None)]),
        ('MATCH (f) WHERE f.name="HandleOrder" OPTIONAL MATCH (f)-[:CALLS]->(g) RETURN f.name, g.name ORDER BY g.name', [("HandleOrder", "LogError"), ("HandleOrder", "ValidateOrder")]),
        ('MATCH (m:Module) MATCH (f:Function) WHERE f.name CONTAINS "Order" RETURN m.name, f.name ORDER BY f.name', [("main", "HandleOrder"), ("main", "SubmitOrder"), ("main", "ValidateOrder")]),
        ("MATCH (m:Module) RETURN m.name UNION MATCH (m:Module) RETURN m.name", [("main",)]),
        ("MATCH (m:Module) RETURN m.name UNION ALL MATCH (m:Module) RETURN m.name", [("main",), ("main",)]),
        ('MATCH (f:Function)-[:CALLS]->(g) WHERE f.name="HandleOrder" RETURN f.name, COLLECT(g.name) AS all', [("HandleOrder", ["LogError", "ValidateOrder"])]),
        ("MATCH (f:Function) RETURN DISTINCT f.label ORDER BY f.label LIMIT 10", [("Function",)]),
        ("MATCH (f:Function) WHERE f.complexity > 2 RETURN f.name, f.complexity", [("HandleOrder", "3")]),
        ("MATCH (f:Function) WHERE f.recursive = true RETURN f.name", [("HandleOrder",)]),
        ("MATCH (a)-[r:CALLS]->(b) WHERE r.confidence >= 0.8 RETURN b.name, r.method, type(r)", [("LogError", "POST", "CALLS")]),
        ('MATCH (a {name: "^Val.*"})<-[:CALLS]-(b) RETURN b.name', [("HandleOrder",)]),
        ("MATCH (f:Function) WHERE NOT EXISTS { (f)<-[:CALLS]-() } RETURN f.name", [("HandleOrder",)]),
        ("MATCH (f:Function) WHERE f.start_line IS NULL RETURN f.name ORDER BY f.name", [("LogError",), ("SubmitOrder",)]),
        ("MATCH (f:Function) RETURN f.out_degree AS o, f.in_degree AS i, f.name ORDER BY f.name", [(2, 0, "HandleOrder"), (0, 1, "LogError"), (0, 1, "SubmitOrder"), (1, 1, "ValidateOrder")]),
        ("MATCH (a)-[:CALLS]-(b) RETURN a.name, count(*) AS n ORDER BY n DESC, a.name", [("HandleOrder", 2), ("ValidateOrder", 2), ("LogError", 1), ("SubmitOrder", 1)]),
        ("MATCH (f:Function) WITH f.name AS n WHERE n ENDS WITH 'r' RETURN n ORDER BY n", [("HandleOrder",), ("LogError",), ("SubmitOrder",), ("ValidateOrder",)]),
        ("UNWIND [1, 2] AS x UNWIND [10, 20] AS y RETURN x + y AS s ORDER BY s", [(11,), (12,), (21,), (22,)]),
        ("MATCH (f:Function) WHERE f.complexity < 0 RETURN max(f.start_line) AS m, count(*) AS n", [(None, 0)]),
        ("MATCH (a)-->()-->(c) RETURN a.name, c.name ORDER BY a.name, c.name", [("HandleOrder", "SubmitOrder"), ("main", "LogError"), ("main", "ValidateOrder")]),
        ("// a remark\nMATCH (m:Module) /* and\nanother */ RETURN m.name AS `the name`", [("main",)]),
        ("MATCH (f:Function) RETURN f.name ORDER BY f.end_line DESC, f.name LIMIT 1", [("HandleOrder",)]),
    ],
)
def test_results(g, text, want):
    assert rows(g, text) == want


def test_depth_is_exact_or_clamped(spark):
    chain = make(spark, [(i, "Function", f"N{i:02}", "a", 1, 2, "{}") for i in range(13)], [(i, i + 1, "CALLS", "{}") for i in range(12)])
    asked = 'MATCH (a)-[:CALLS*{}]->(b) WHERE a.name = "N00" RETURN b.name ORDER BY b.name'
    assert rows(chain, asked.format("1..12")) == rows(chain, asked.format("")) == [(f"N{i:02}",) for i in range(1, 13)]
    assert rows(chain, asked.format("11..")) == [("N11",), ("N12",)]
    assert rows(chain, asked.format("1..12"), depth=10) == rows(chain, asked.format(""), depth=10) == [(f"N{i:02}",) for i in range(1, 11)]


def test_compat(g):
    assert rows(g, "MATCH (m:Module) RETURN m.file_path AS f, count(m.file_path) AS n", compat=True) == [("", 1)]
    assert rows(g, "MATCH (m:None) RETURN count(*) AS n", compat=True) == [] and rows(g, "MATCH (m:None) RETURN count(*) AS n") == [(0,)]
    assert rows(g, "MATCH (f:Function) RETURN DISTINCT f.label AS l ORDER BY f.label LIMIT 2", compat=True) == [("Function",)]


def typed(spark) -> PropertyGraph:
    """The same kind of graph in tables by label and type; edges of one type lie in two tables."""
    def nodes(label, ids):
        return NodeTable(label, spark.createDataFrame([(i, f"{label}{i}", i % 5) for i in ids], "id bigint, name string, size int"))

    def edges(kind, a, b, pairs):
        return EdgeTable(kind, spark.createDataFrame(pairs, "source_id bigint, target_id bigint"), a, b)

    a, b, c = range(1, 9), range(11, 19), range(21, 25)
    r = random.Random(3)
    pick = lambda x, y, n: sorted({(r.choice(x), r.choice(y)) for _ in range(n)})
    tables = (edges("X", "A", "B", pick(a, b, 14)), edges("X", "A", "C", pick(a, c, 8)), edges("Y", "B", "C", pick(b, c, 9)), edges("Y", "A", "A", pick(a, a, 9)))
    return PropertyGraph(node_tables=(nodes("A", a), nodes("B", b), nodes("C", c)), edge_tables=tables, spark=spark)


@pytest.mark.parametrize("seed", range(8))
def test_typed_graphs_equal_a_naive_interpreter(spark, seed):
    """Several patterns with labels asked again, OPTIONAL, EXISTS and counts over a typed graph."""
    graph, r = typed(spark), random.Random(seed)
    label = {i: t.label for t in graph.node_tables for i in [x.id for x in t.df.collect()]}
    edges = [(x.source_id, x.target_id, t.type) for t in graph.edge_tables for x in t.df.collect()]
    l1, l2, l3 = (r.choice("ABC") for _ in range(3))
    k1, k2, k3 = (r.choice("XY") for _ in range(3))
    optional, negated = r.random() < 0.5, r.random() < 0.5
    text = f"MATCH (p:{l1})-[:{k1}]->(q) {'OPTIONAL ' if optional else ''}MATCH (q:{l2})-[:{k2}]->(s) WITH p, q, s WHERE {'NOT ' if negated else ''}EXISTS {{ (p)-[:{k3}]->(:{l3}) }} RETURN id(p) AS p, id(q) AS q, count(s) AS n"
    text = text.replace(f"(:{l3})", f"(z:{l3})")
    want: dict[tuple, int] = {}
    for a, b, k in edges:
        if k != k1 or label[a] != l1:
            continue
        if any(x == a and j == k3 and label[y] == l3 for x, y, j in edges) == negated:
            continue
        on = [y for x, y, j in edges if x == b and j == k2 and label[b] == l2]
        if on or optional:
            want[a, b] = want.get((a, b), 0) + len(on)
    assert sorted(rows(graph, text)) == sorted((a, b, n) for (a, b), n in want.items())


@pytest.mark.parametrize("text", ["CREATE (n)", "MATCH (n) DELETE n", "MATCH (n) RETURN foo(n)", "MATCH (n) RETURN n[0]", "MATCH (n) RETURN m.name", "MATCH (n WHERE", "MATCH (n) WHERE n.a ~ 1 RETURN n", "RETURN", "", "MATCH (a) RETURN a.name UNION MATCH (a) RETURN a.name, a.label"])
def test_errors(g, text):
    with pytest.raises(QueryError):
        run(g, text)


def test_the_ceiling(g):
    assert len(rows(g, "MATCH (n) RETURN n.name", max_rows=5)) == 5
    with pytest.raises(QueryError):
        run(g, "MATCH (n) RETURN n.name", max_rows=4)


def test_plans(spark):
    from graphlake.sources.tables import bench_graph

    graph = bench_graph(spark, "/root/testdata/sf0.001")
    plan = lambda text: run(graph, text)._jdf.queryExecution().executedPlan().toString()
    scan = plan("MATCH (o:Order) WHERE o.o_totalprice > 1000 RETURN o.o_orderkey")
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000" in scan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in scan
    assert scan.count("FileScan") == 1
    assert "LeftSemi" in plan("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->() } RETURN c.name")
    assert "LeftAnti" in plan("MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->() } RETURN c.name")


LABELS, TYPES = ["A", "B"], ["X", "Y"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_random_graphs_equal_a_naive_interpreter(spark, seed):
    r = random.Random(seed)
    nodes = [(i, r.choice(LABELS), f"n{i}", "f", i, i + r.randint(0, 3), "{}") for i in range(r.randint(1, 7))]
    edges = list({(r.randrange(len(nodes)), r.randrange(len(nodes)), r.choice(TYPES)) for _ in range(r.randint(1, 12))})
    graph = make(spark, nodes, [(*e, "{}") for e in edges])
    label, kind, way, limit = r.choice(LABELS), r.choice(TYPES), r.choice(["out", "in", "any"]), r.randint(0, 6)
    arrow = {"out": f"-[:{kind}]->", "in": f"<-[:{kind}]-", "any": f"-[:{kind}]-"}[way]
    want = []
    for s, t, k in edges:
        if k == kind:
            want += [(s, t)] * (way != "in") + [(t, s)] * (way != "out")
    want = sorted((f"n{a}", f"n{b}") for a, b in want if nodes[a][1] == label and nodes[b][4] >= limit)
    assert sorted(rows(graph, f"MATCH (a:{label}){arrow}(b) WHERE b.start_line >= {limit} RETURN a.name AS a, b.name AS b")) == want


def test_unwind_and_words_parse():
    q = parse("UNWIND ['x'] AS v MATCH (n:A|B {k: 1})-[r:T|U*2..]->(m) WHERE n.a IN [1, 2] XOR NOT m:A RETURN n, CASE n.x WHEN 1 THEN 'a' END AS c SKIP 1 LIMIT 2")
    assert q.clauses[1].paths[0].edges[0].least == 2 and q.clauses[1].paths[0].edges[0].most is None


CYCLES = [
    "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier) MATCH (c)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part)-[:SUPPLIED_BY]->(s) RETURN n.name AS nation, count(*) AS n ORDER BY n DESC, nation LIMIT 7",
    "MATCH (p:Part)-[:SUPPLIED_BY]->(s:Supplier)-[:IN_NATION]->(n), (o)-[:CONTAINS]->(p), (c)-[:PLACED]->(o), (c {c_mktsegment: 'BUILDING'})-[:IN_NATION]->(n:Nation {n_regionkey: 1}) RETURN count(*) AS n",
    "MATCH (a:Customer)-[:IN_NATION]->(n)<-[:IN_NATION]-(b:Customer), (a)-[:IN_NATION]->(m)<-[:IN_NATION]-(b) RETURN m.name AS m, n.n_regionkey AS r, count(*) AS n",
    "MATCH (a:Order)-[:CONTAINS]->(p:Part)<-[:CONTAINS]-(b:Order), (a)-[:CONTAINS]->(q:Part)<-[:CONTAINS]-(b) WHERE p.p_size < q.p_size RETURN count(*) AS n",
    "MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation), (a)-[:IN_REGION]->(x)<-[:IN_NATION]-(b) RETURN count(*) AS n",
]


@pytest.mark.parametrize("text", CYCLES)
def test_counts_of_cycles_equal_their_listed_matches(spark, monkeypatch, text):
    graph = bench_graph(spark, "/root/testdata/sf0.001")
    got = [r.asDict() for r in run(graph, text).collect()]
    monkeypatch.setattr(compiler.Compiler, "counted", lambda self, q: None)
    want = [r.asDict() for r in run(graph, text).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_counts_of_cycles_are_summed_on_the_way(spark):
    """Customers and suppliers of a nation never meet as pairs: each join is of sums but for the first of each side."""
    plan = run(bench_graph(spark, "/root/testdata/sf0.001"), CYCLES[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 6
