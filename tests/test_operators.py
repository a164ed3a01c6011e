"""Operators on small hand-made tables."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlake import queries
from graphlake.functions import scalar
from graphlake.operators import arch, communities, derive, dml, incremental, lineage, packed, search, similarity, traverse
from graphlake.schema import EDGE, NODE
from graphlake.sources import files, texts
from graphlake.streaming import poller


def graph(spark, nodes, edges):
    """nodes: (id, label, name, qualified name, file, start, end, properties); edges: (source, target, type, properties)."""
    n = [(i, "p", label, name, qn, file, a, b, props) for i, label, name, qn, file, a, b, props in nodes]
    return spark.createDataFrame(n, NODE), spark.createDataFrame([(k, "p", *e) for k, e in enumerate(edges)], EDGE)


def fn(i, name, file="a.go", props="{}", a=1, b=9):
    return (i, "Function", name, f"p.src.{name}", file, a, b, props)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


# -- scalars


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: scalar.url_path(F.lit("https://example.com/api/items?page=1")), "/api/items"),
        (lambda: scalar.url_path(F.lit("relative")), ""),
        (lambda: scalar.route_canonical(F.lit("/players/:id")), "/players/{}"),
        (lambda: scalar.route_canonical(F.lit("/players/{id}/x/<int:y>")), "/players/{}/x/{}"),
        (lambda: scalar.route_canonical(F.lit("/players/${playerId}")), "/players/{}"),
        (lambda: scalar.route_canonical(F.lit("/a/b:c")), "/a/b:c"),
        (lambda: scalar.route_canonical(F.lit(None).cast("string")), ""),
        (lambda: scalar.package(F.lit("project.internal.store.search.Search")), "store"),
        (lambda: scalar.package(F.lit("project.main.foo")), "main"),
        (lambda: scalar.package(F.lit("standalone")), ""),
        (lambda: scalar.top_package(F.lit("proj.dir.sub.Func")), "dir"),
        (lambda: scalar.duration_ns(F.lit("10"), F.lit("50000010")), 50_000_000),
        (lambda: scalar.duration_ns(F.lit("10"), F.lit("3")), 0),
        (lambda: scalar.duration_ns(F.lit(None).cast("string"), F.lit("3")), 0),
        (lambda: scalar.duration_ns(F.lit("1"), F.lit(None).cast("string")), 0),
        (lambda: scalar.duration_ns(F.lit("x"), F.lit("3")), 0),
        (lambda: scalar.hop_risk(F.lit(-1)), "LOW"),
        (lambda: scalar.hop_risk(F.lit(2)), "HIGH"),
        (lambda: scalar.camel_split(F.lit("updateCloudClient")), "updateCloudClient update Cloud Client"),
        (lambda: scalar.camel_split(F.lit("XMLParser")), "XMLParser XML Parser"),
        (lambda: scalar.camel_split(F.lit("")), ""),
        (lambda: scalar.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))), 1.0),
        (lambda: scalar.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0))), 0.0),
        (lambda: scalar.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0), F.lit(1.0))), 0.0),
        (lambda: scalar.is_test_file(F.lit("handler.spec.ts")), False),
        (lambda: scalar.is_test_path(F.lit("handler.spec.ts")), True),
        (lambda: scalar.is_test_path(F.lit("src/main.go")), False),
        (lambda: scalar.is_test_name(F.lit("TestFoo")), True),
        (lambda: scalar.is_test_name(F.lit("Testable")), False),
        (lambda: scalar.to_integer(F.lit("1.9")), 1),
        (lambda: scalar.to_integer(F.lit("12x")), 12),
        (lambda: scalar.to_integer(F.lit("x")), None),
        (lambda: scalar.to_boolean(F.lit("TRUE")), True),
        (lambda: scalar.substring(F.lit("hello"), F.lit(1), F.lit(3)), "ell"),
        (lambda: scalar.substring(F.lit("hello"), F.lit(9)), ""),
        (lambda: scalar.trim(F.lit("\t x \n")), "x"),
        (lambda: scalar.config_key(F.lit("maxRetry-count.x")), "max_retry_count_x"),
        (lambda: scalar.code_tokens(F.lit("parseErr_ctx")), ["parse", "err", "ctx", "error", "context"]),
        (lambda: scalar.decorator_tokens(F.lit("@app.cacheResult(ttl=3)")), ["cache", "result"]),
        (lambda: scalar.is_env_name(F.lit("DB_URL")), True),
        (lambda: scalar.is_env_name(F.lit("x")), False),
        (lambda: scalar.minhash_unhex(scalar.minhash_hex(F.array(F.lit(255), F.lit(7)))), [255, 7]),
        (lambda: scalar.module_name(F.lit("p"), F.lit("a/b/__init__.py")), "p.a.b"),
        (lambda: scalar.qualified_name(F.lit("p"), F.lit("a/x.py"), F.lit("f")), "p.a.x.f"),
        (lambda: similarity.path_proximity(F.lit("a/b/c.py"), F.lit("a/b/d.py")), 1.1),
        (lambda: similarity.path_proximity(F.lit("c.py"), F.lit("d.py")), 1.0),
    ],
)
def test_scalars(spark, column, want):
    got = one(spark, column())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_pattern_helpers():
    pairs = {"**/*.py": "%%.py", "**/dir/**": "%dir%", "*.go": "%.go", "src/**": "src%", "**/test_*.py": "%test_%.py", "file?.txt": "file_.txt", "exact.go": "exact.go", "**/custom-pip-package/**": "%custom-pip-package%"}
    assert {p: scalar.glob_to_like(p) for p in pairs} == pairs and scalar.glob_to_like(None) is None
    hints = {".*handler.*": ["handler"], ".*Order.*Handler.*": ["Order", "Handler"], "^handleRequest$": ["handleRequest"], ".*": [], ".*ab.*": [], ".*abc.*": ["abc"], ".*foo|.*bar": [], "\\.": [], ".*test_.*helper.*": ["test_", "helper"]}
    assert {p: scalar.like_hints(p) for p in hints} == hints


@pytest.mark.parametrize(("values", "want"), [(range(10, 101, 10), 100), ([5, 500], 500), ([42], 42), (range(1, 101), 100), ([], 0)])
def test_p99(spark, values, want):
    values = list(values)
    assert one(spark, texts.p99(F.array(*map(F.lit, values)) if values else F.array().cast("array<int>"))) == want
    if values:
        df = spark.createDataFrame([("k", v) for v in values], "k string, v int")
        assert texts.p99_by(df, ["k"], "v").head().p99 == want


# -- walks


def test_bfs(spark):
    n, e = graph(spark, [fn(1, "A"), fn(2, "B"), fn(3, "C"), fn(4, "D")], [(1, 2, "CALLS", "{}"), (2, 3, "CALLS", "{}"), (3, 4, "CALLS", "{}")])
    assert [(r.name, r.hop) for r in traverse.bfs(n, e, 1, depth=1).collect()] == [("B", 1)]
    assert [(r.name, r.hop) for r in traverse.bfs(n, e, 1, depth=9).collect()] == [("B", 1), ("C", 2), ("D", 3)]
    assert [r.name for r in traverse.bfs(n, e, 3, "inbound").collect()] == ["B", "A"]
    n, e = graph(spark, [fn(1, "Root", "r.c"), fn(2, "Beta", "zeta.c"), fn(3, "Alpha", "alpha.c")], [(1, 2, "CALLS", "{}"), (2, 1, "CALLS", "{}"), (1, 3, "CALLS", "{}"), (3, 1, "CALLS", "{}")])
    assert [(r.name, r.hop) for r in traverse.bfs(n, e, 1, depth=5).collect()] == [("Alpha", 1), ("Beta", 1)]
    assert {(r.name, r.risk, r.direction) for r in traverse.trace(n, e, 1, "both").collect()} == {(x, "CRITICAL", d) for x in ("Alpha", "Beta") for d in ("inbound", "outbound")}


def test_impact(spark):
    visits = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (3, 3)], "id bigint, hop int")
    _, e = graph(spark, [], [(1, 2, "HTTP_CALLS", "{}")])
    assert traverse.impact_summary(visits, e).head().asDict() == {"critical": 1, "high": 1, "medium": 1, "low": 0, "total": 3, "has_cross_service": True}
    n, e = graph(spark, [fn(1, "funcA", "main.go", a=1, b=10), fn(2, "funcB", "main.go", a=12, b=25), fn(3, "funcC", "x.go", a=1, b=50), (4, "Module", "main", "p.main", "main.go", 1, 100, "{}")], [(3, 1, "CALLS", "{}")])
    for (a, b), want in {(5, 8): [1], (8, 15): [1, 2], (26, 30): []}.items():
        assert sorted(r.id for r in dml.overlapping(n, "main.go", a, b).collect()) == want
        hunk = spark.createDataFrame([("main.go", a, b)], "file_path string, start int, end int")
        assert sorted(r.id for r in traverse.changed_symbols(n, hunk).collect()) == want
    assert [(r.id, r.hop) for r in traverse.impact(n, e, spark.createDataFrame([("main.go", 5, 8)], "file_path string, start int, end int")).collect()] == [(3, 1)]


def test_loop_depth_and_status(spark):
    n = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", 0), (5, "e", 1)], "id bigint, qualified_name string, loop_depth int")
    e = spark.createDataFrame([(1, 2, "CALLS"), (2, 3, "CALLS"), (4, 5, "CALLS"), (5, 4, "CALLS")], "source_id bigint, target_id bigint, type string")
    got = {r.id: (r.tld, r.recursive) for r in traverse.loop_depths(n, e).collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {1: (6, False), 2: (5, False), 3: (3, False)} and got[4][1] and got[5][1]
    assert {r.id: (r.tld, r.recursive) for r in traverse.loop_depths(n, e, 0).collect()} == got
    nodes, edges = graph(spark, [fn(1, "used"), fn(2, "dead"), fn(3, "main", props='{"is_entry_point":true}'), fn(4, "t", "a_test.go"), (5, "Class", "C", "p.C", "a", 1, 1, "{}"), fn(6, "out", props='{"is_exported":true}')], [(3, 1, "CALLS", "{}")])
    assert {r.name: r.status for r in traverse.code_status(nodes, edges).collect()} == {"used": "single", "dead": "dead", "main": "entry", "t": "test", "C": "structural", "out": "exported"}


def clique(ids):
    return [(a, b) for a in ids for b in ids if a < b]


@pytest.mark.parametrize(
    ("links", "nodes", "least", "most"),
    [
        (clique([1, 2, 3]) + [(4, 5)], range(1, 6), 2, 2),
        (clique(range(10)) + clique(range(10, 20)) + [(9, 10)], range(20), 2, 2),
        (sum((clique(range(8 * k, 8 * k + 8)) for k in range(4)), []) + [(7, 8), (15, 16), (23, 24)], range(32), 2, 5),
        ([], [1], 1, 1),
    ],
)
def test_leiden(spark, links, nodes, least, most):
    n = spark.createDataFrame([(i,) for i in nodes], "id bigint")
    rows = communities.leiden(n, spark.createDataFrame(links, "a bigint, b bigint")).collect()
    groups: dict[int, set] = {}
    for r in rows:
        groups.setdefault(r.community, set()).add(r.id)
    assert len(rows) == len(list(nodes)) and least <= len(groups) <= most
    for c, members in groups.items():
        assert c == min(members)
        seen, todo = {c}, [c]
        while todo:
            x = todo.pop()
            for a, b in links:
                for u, v in ((a, b), (b, a)):
                    if u == x and v in members and v not in seen:
                        seen.add(v)
                        todo.append(v)
        assert seen == members


def test_leiden_over_all_tasks(spark):
    """A giant component: three groups of cliques in a ring, found by joins alone, no worse than in one task."""
    links = sum((clique(range(8 * k, 8 * k + 8)) for k in range(4)), []) + [(7, 8), (15, 16), (23, 24), (31, 0)]
    n, e = spark.range(32), spark.createDataFrame(links, "a bigint, b bigint")
    ways = spark.createDataFrame([(a, b, 1.0) for a, b in links] + [(b, a, 1.0) for a, b in links], "u bigint, v bigint, w double")
    quality = []
    for together in (0, 10**6):
        member = communities.leiden(n, e, together=together)
        rows = member.collect()
        quality.append(communities.modularity(ways, member, len(links)))
        groups: dict[int, set] = {}
        for r in rows:
            groups.setdefault(r.community, set()).add(r.id)
        assert len(rows) == 32 and all(c == min(m) for c, m in groups.items())
        inside = spark.createDataFrame([(a, b) for a, b in links if any(a in m and b in m for m in groups.values())], "a bigint, b bigint")
        assert {r.id: r.component for r in communities.components(n, inside).collect()} == {r.id: r.community for r in rows}
    assert quality[0] >= quality[1] - 0.05 and quality[0] > 0.5


@pytest.mark.parametrize("held", [0, 10**6])
def test_leiden_joined_or_packed(spark, held):
    """Links that come twice, both ways, to themselves, with null or unlisted ends; small components beside a large one; isolated and null nodes."""
    links = sum((clique(range(8 * k, 8 * k + 8)) for k in range(6)), []) + [(8 * k + 7, (8 * k + 8) % 48) for k in range(6)] + clique([100, 101, 102]) + [(200, 201)]
    twice = [*links, *((b, a) for a, b in links[::2]), (3, 3), (None, 4), (5, None), (-7, 200)]
    n = spark.createDataFrame([(i,) for i in [*range(48), 100, 101, 102, 200, 201, 300, None]], "id bigint")
    rows = communities.leiden(n, spark.createDataFrame(twice, "a bigint, b bigint"), together=10, held=held).collect()
    got = {r.id: r.community for r in rows}
    assert len(rows) == len(got) == 55 and got[None] is None and got[300] == 300
    assert {got[100], got[101], got[102]} == {100} and {got[200], got[201]} == {-7}
    links += [(-7, 200)]
    groups: dict[int, set] = {-7: {-7}}
    for i in [*range(48), 100, 101, 102, 200, 201]:
        groups.setdefault(got[i], set()).add(i)
    assert all(c == min(m) for c, m in groups.items())
    inside = spark.createDataFrame([(a, b) for a, b in links if any(a in m and b in m for m in groups.values())], "a bigint, b bigint")
    assert all(got[r.id] == r.component for r in communities.components(n.na.drop(), inside).collect())
    # whole cliques
    assert all(len({got[i] for i in range(8 * k, 8 * k + 8)}) == 1 for k in range(6))


def test_leiden_rounds_take_few_jobs_and_no_joins(spark):
    """A round over packed links is one job without a shuffle, whatever the number of links, as joins of all links in each made it too long."""
    random.seed(3)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(1500)]
    df = spark.createDataFrame(links, "a bigint, b bigint").filter("a <> b")
    chunks = packed.gather(df)
    ids = packed.ends(chunks, 10**6)
    graph = packed.pack(chunks, ids)
    want = {(a, b) for a, b in links if a != b} | {(b, a) for a, b in links if a != b}
    assert ids.tolist() == sorted({a for a, _ in want}) and graph.links == len(want) and packed.ends(chunks, 10) is None
    place = {x: i for i, x in enumerate(ids.tolist())}
    assert {(r.a, r.b) for r in packed.links_of(graph).collect()} == {(place[a], place[b]) for a, b in want if a < b}
    # the modularity of a step against its definition over rows, and no node worse off for its own move
    n, total, community = len(ids), len(want) // 2, np.arange(len(ids), dtype=np.int32) // 7
    ways = spark.createDataFrame([(place[a], place[b], 1.0) for a, b in want], "u bigint, v bigint, w double")
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("round", "round")
    new, quality = packed.moves(graph, community, 0, 2.0 * total, 1.0)
    jobs = tracker.getJobIdsForGroup("round")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1 and len(tracker.getJobInfo(jobs[0]).stageIds) == 1

    def of(c):
        return communities.modularity(ways, spark.createDataFrame(list(enumerate(c.tolist())), "id bigint, community bigint"), total)

    assert abs(quality - of(community)) < 1e-9 and (new != community).any()
    for u in np.flatnonzero(new != community)[:3]:
        alone = community.copy()
        alone[u] = new[u]
        assert of(alone) > quality
    # the same after contraction, where nodes have links to themselves
    part = np.unique(community, return_inverse=True)[1]
    small = packed.contract(graph, part, part.max() + 1)
    assert abs(packed.moves(small, np.arange(part.max() + 1, dtype=np.int32), 0, 2.0 * total, 1.0)[1] - quality) < 1e-9
    assert small.degree.sum() == 2 * total and len(small.degree) < n


@pytest.mark.parametrize("pairs", [0, 200])
def test_packed_components(spark, pairs):
    """A long path and many small components or none, within equal values."""
    links = [(i, i + 1) for i in range(300)] + [(1000 + 2 * i, 1001 + 2 * i) for i in range(pairs)] + [(2000 + 7 * i % 97, 2000 + 7 * (i + 1) % 97) for i in range(60)]
    chunks = packed.gather(spark.createDataFrame(links, "a bigint, b bigint"))
    ids = packed.ends(chunks, 10**6)
    graph = packed.pack(chunks, ids)
    for within in (None, (np.arange(len(ids)) // 50).astype(np.int32)):
        kept = [(a, b) for a, b in links if within is None or within[np.searchsorted(ids, a)] == within[np.searchsorted(ids, b)]]
        want = {r.id: r.component for r in communities.components(spark.createDataFrame([(int(i),) for i in ids], "id bigint"), spark.createDataFrame(kept, "a bigint, b bigint")).collect()}
        assert dict(zip(ids.tolist(), ids[packed.components(graph, within)].tolist())) == want


def test_resolution_is_monotone():
    path = [(i, i + 1) for i in range(29)]
    sizes = [len(set(communities.communities(path, 29, r).values())) for r in (0.2, 1.0, 3.0)]
    assert sizes == sorted(sizes)


def test_components(spark):
    random.seed(1)
    links = [(random.randrange(60), random.randrange(60)) for _ in range(40)]
    top = list(range(60))
    for _ in range(60):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    rows = communities.components(spark.range(60), spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.id: r.component for r in rows} == dict(enumerate(top))


# -- search


@pytest.fixture(scope="module")
def small(spark):
    return graph(spark, [fn(1, "SubmitOrder", "main.go"), fn(2, "ProcessOrder", "service.go"), (3, "Class", "OrderService", "p.OrderService", "service.go", 1, 9, "{}")], [(1, 2, "CALLS", "{}")])


@pytest.mark.parametrize(("ask", "want"), [({"label": "Function"}, 2), ({"name": ".*Submit.*"}, 1), ({"name": "submit"}, 1), ({"name": "submit", "case_sensitive": True}, 0), ({"file": "service*"}, 2), ({}, 3), ({"exclude_entry_points": True}, 2), ({"min_degree": 1}, 2), ({"max_degree": 0}, 1), ({"relationship": "CALLS", "direction": "inbound"}, 1)])
def test_structural_search(small, ask, want):
    n, e = small
    hits = search.structural(n, e, search.Search(**ask))
    assert hits.count() == want and search.page(hits, search.Search(limit=1, offset=1)).count() == (want > 1)


def test_full_text(spark, small):
    n, _ = small
    assert [r.name for r in search.full_text(n, "submitorder").collect()] == ["SubmitOrder"]
    assert search.full_text(n, "").count() == 0
    files_ = spark.createDataFrame([("main.go", "a\nneedle here\nc")], "file_path string, content string")
    assert [(r.line, r.qualified_name) for r in search.code_search(files_, n, "needle").collect()] == [(2, "p.src.SubmitOrder")]
    assert search.snippet(files_, n, "SubmitOrder").head().source == "a\nneedle here\nc"


def test_vectors(spark):
    v = spark.createDataFrame([(1, "p", [1.0, 0.0]), (2, "p", [0.0, 1.0]), (3, "p", [0.6, 0.8])], "node_id bigint, project string, vector array<float>")
    assert [r.node_id for r in search.vector_search_many(v, {"q": [0.0, 1.0]}, k=2).collect()] == [2, 3]
    with pytest.raises(ValueError):
        search.vector_search_many(v, {"q": [1.0]})
    t = spark.createDataFrame([("p", "order", [1.0, 0.0], 2.0), ("p", "log", [0.0, 1.0], 1.0)], "project string, token string, vector array<float>, idf float")
    assert search.query_vector(t, ["Order", "log"]) == [2.0, 1.0] and search.query_vector(t, ["none"]) is None


# -- similarity


def test_minhash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z u v w q"), (4, "one"), (5, ""), (6, None)], "id bigint, text string")
    signed = similarity.minhash(docs, "id", "text")
    assert sorted(r.id for r in signed.collect()) == [1, 2, 3, 4]
    assert similarity.candidates(signed, "id").count() == 0
    assert sorted((r.rep, r.id) for r in similarity.representatives(signed, "id").collect()) == [(1, 1), (1, 2), (3, 3), (4, 4)]
    loose = signed.select((F.col("id") + 10).alias("id"), F.transform("signature", lambda x, i: F.when(i < 40, x).otherwise(-F.col("id"))).alias("signature"))
    pairs = similarity.scored(similarity.candidates(signed.union(loose), "id"), signed.union(loose), "id").collect()
    assert sorted((r.a, r.b) for r in pairs if r.jaccard == 40 / 64 and r.a in (3, 4)) == [(3, 13), (4, 14)]
    nodes = spark.createDataFrame([(1, "p.a", "x.py"), (2, "p.b", "x.go"), (3, "p.c", "y.py"), (4, "p.d", "z.py")], "id bigint, qualified_name string, file_path string")
    assert similarity.similar_edges(nodes, signed).count() == 0
    assert similarity.similar_edges(nodes.withColumn("file_path", F.lit("x.py")), signed).collect()[0][:2] == (1, 2)


def test_semantic_budget(spark):
    pairs = [(0, i, 1.0 - i / 100) for i in range(1, 15)] + [(1, 2, 0.76)]
    got = similarity.semantic_edges(spark.createDataFrame(pairs, "a bigint, b bigint, score double"), budget=10).collect()
    assert sorted((r.a, r.b) for r in got) == [(0, i) for i in range(1, 11)] + [(1, 2)]


def test_semantic_score_equals_brute_force(spark, tmp_path, monkeypatch):
    """Over all rows, in several blocks, with every pair that shares one of 16 bands of 4 planes."""
    monkeypatch.setattr(similarity, "BLOCK", 90)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(260, 64)) + 1.1 * rng.normal(size=(6, 64))[rng.integers(0, 6, 260)]
    v[17] = 0
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    v, x, planes = v.astype(np.float32).astype(float), 7, np.zeros((64, 64))
    for p in range(64):
        for d in range(64):
            x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            planes[p, d] = 1 if x >> 63 else -1
    bits = (v @ planes.T >= 0).reshape(260, 16, 4)
    pairs = []
    for a in range(260):
        for b in range(a + 1, 260):
            score = 0.85 * float(v[a] @ v[b]) / max(float(np.linalg.norm(v[a]) * np.linalg.norm(v[b])), 1e-12)
            if score >= 0.3 and (bits[a] == bits[b]).all(axis=1).any():
                pairs.append((-score, a, b))
    used, want = [0] * 260, {}
    for score, a, b in sorted(pairs):
        if used[a] < 10 and used[b] < 10:
            used[a], used[b], want[a, b] = used[a] + 1, used[b] + 1, -score
    got = {(r.a, r.b): r.score for r in queries.QUERIES["semantic_score"](spark, str(tmp_path)).collect()}
    assert len(pairs) > len(want) > 200 and max(b for _, b in want) >= 200
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)


def test_searches_in_blocks_and_in_two_stages(spark, monkeypatch):
    """All vectors against every 50th: exact in blocks, and nine of ten neighbours or more from codes."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 64)) + 1.5 * rng.normal(size=(30, 64))[rng.integers(0, 30, 900)]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None)], "id bigint, vector array<float>")
    queries_ = rows.filter("id % 50 = 0")
    v = v.astype(np.float32).astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 12)
    want = {q: [int(i) for i in np.lexsort((np.arange(900), -score[q]))[:10]] for q in range(0, 900, 50)}
    for size in (4096, 7):
        monkeypatch.setattr(search, "SCANNED", size)
        got = search.nearest(rows, queries_, 10).collect()
        assert {q: [r.id for r in sorted(got, key=lambda r: r.rank) if r.query == q] for q in want} == want
        near = search.two_stage(rows, queries_, 10, prefetch=100).collect()
        found = sum(r.id in want[r.query] for r in near)
        assert len(near) == 10 * len(want) and found >= 0.9 * len(near)
        assert sorted((r.query, r.rank, r.id) for r in search.two_stage(rows, queries_, 10, prefetch=900).collect()) == sorted((q, k + 1, i) for q, ids in want.items() for k, i in enumerate(ids))
    assert search.nearest(rows, rows.limit(0)).count() == 0


def test_scope_and_pages(spark, small):
    projects = spark.createDataFrame([("p", "a/p", True, True), ("q", "q", True, False), ("r", "q", True, True)], "project string, selector string, ready boolean, healthy boolean")
    assert search.scope(projects, ["*"]) == ["p", "r"] and search.scope(projects, ["a/p", "p", "r"]) == ["p", "r"]
    for bad in (["none"], ["q"]):
        with pytest.raises(ValueError):
            search.scope(projects, bad)
    page, total = search.structural_in(*small, ["p"], search.Search(limit=1, offset=1))
    assert page.count() == 1 and total == 3 and search.full_text_in(small[0], "submitorder", ["p"])[1] == 1
    vectors = spark.createDataFrame([(1, "p", [1.0, 0.0], "m"), (2, "p", [0.0, 1.0], "m"), (3, "x", [0.0, 1.0], "other")], "node_id bigint, project string, vector array<float>, model string")
    tokens = spark.createDataFrame([("p", "order", [1.0, 0.0], 2.0, "m")], "project string, token string, vector array<float>, idf float, model string")
    assert [r.node_id for r in search.search_projects(vectors, tokens, ["order"], ["p"], 1).collect()] == [1]
    with pytest.raises(ValueError):
        search.search_projects(vectors, tokens, ["order"], ["p", "x"])


def test_similar_pairs_equal_brute_force(spark, monkeypatch):
    random.seed(4)
    base = [[f"w{random.randrange(300)}" for _ in range(40)] for _ in range(6)]
    texts_ = []
    for i in range(90):
        own = list(base[i % 6])
        for _ in range(random.choice([0, 0, 1, 3])):
            own[random.randrange(40)] = f"x{i}"
        texts_.append((i, " ".join(own)))
    signed = similarity.minhash(spark.createDataFrame(texts_, "id bigint, text string"), "id", "text").cache()
    places = {r.id: r.signature for r in signed.collect()}
    first: dict[tuple, int] = {}
    for i in sorted(places):
        first.setdefault(tuple(places[i]), i)
    want = {}
    for a in first.values():
        for b in first.values():
            same = [x == y for x, y in zip(places[a], places[b])]
            if a < b and sum(same) >= 0.6 * 64 and any(all(same[k : k + 2]) for k in range(0, 64, 2)):
                want[a, b] = sum(same) / 64
    for members in (512, 3):
        monkeypatch.setattr(similarity, "MEMBERS", members)
        got = similarity.similar_pairs(signed, "id", 0.6).collect()
        assert len(got) == len(want) > 20 and {(r.a, r.b): r.jaccard for r in got} == want
    assert {(r.rep, r.id) for r in similarity.representatives(signed, "id").collect()} == {(first[tuple(s)], i) for i, s in places.items()}


def test_vectors_of_tokens(spark):
    t = spark.createDataFrame([(d, p, w) for d, text in enumerate(["get user name", "get user mail", "draw red box"]) for p, w in enumerate(text.split())], "doc int, pos int, token string")
    v = {r.token: np.array(r.vector) for r in similarity.token_vectors(t, 32).collect()}
    assert all(np.linalg.norm(x) == pytest.approx(1) for x in v.values()) and v["name"] @ v["mail"] > v["name"] @ v["red"]
    d = similarity.document_vectors(t, similarity.token_vectors(t, 32), 32).collect()
    assert len(d) == 3
    moved = similarity.diffuse(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, vector array<double>"), spark.createDataFrame([(1, 2)], "source_id bigint, target_id bigint"), 0.5, 2)
    assert all(r.vector == pytest.approx([2**-0.5] * 2) for r in moved.collect())


def test_token_vectors_meet_no_join_of_tokens(spark):
    """Gaps and two tokens at a place count as they do in a join by place; missing places meet nobody."""
    rows = [(d, p, f"w{(d * 7 + p * p) % 23}") for d in range(40) for p in (0, 1, 1, 2, 9, 10, 13, 30) if (d + p) % 5] + [(None, 1, "w1"), (3, None, "w2")]
    t = spark.createDataFrame(rows, "doc int, pos int, token string")
    own, weights = [r for r in rows if None not in r], {}
    for d, p, a in own:
        for e, q, b in own:
            if d == e and 0 < abs(p - q) <= similarity.WINDOW:
                weights[a, b] = weights.get((a, b), 0.0) + 1.0 / abs(p - q)
    v = {r.token: np.array(r.v) for r in t.select("token").distinct().select("token", similarity.normalised(similarity.base_vector(F.col("token"), 32)).alias("v")).collect()}
    for _ in range(2):
        near = {a: sum(w * v[b] for (x, b), w in weights.items() if x == a) for a in v}
        v = {a: 0.3 * v[a] + 0.7 * near[a] / (np.linalg.norm(near[a]) or 1) if np.ndim(near[a]) else v[a] for a in v}
        v = {a: x / np.linalg.norm(x) for a, x in v.items()}
    got = similarity.token_vectors(t, 32)
    assert {r.token: r.vector for r in got.collect()} == {a: pytest.approx(x) for a, x in v.items()}


def test_token_vectors_join_no_rows_of_tokens(spark, monkeypatch):
    """Joins are of distinct tokens: those of all tokens, listed for each place near, were broadcast by a small file's size."""
    frames = []
    monkeypatch.setattr(similarity, "cut", lambda df: frames.append(df) or lineage.cut(df))
    t = spark.range(50).select(F.col("id").alias("doc"), F.posexplode(F.array(*(F.lit(f"w{i}") for i in range(9)))).alias("pos", "token"))
    frames.append(similarity.token_vectors(t, 8))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in frames]
    assert any("explode" in p for p in plans) and not [p for p in plans if "explode" in p and "Join" in p]


def test_rotated_codes():
    x = np.random.default_rng(1).normal(size=(20, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = similarity.rotated_codes(x)
    assert np.abs(similarity.code_products(codes, codes) - x @ x.T).max() < 0.05


# -- derived edges


def test_name_resolution(spark):
    nodes = spark.createDataFrame([(1, "p.lib.util.load"), (2, "p.app.main.run"), (3, "p.x.only"), (4, "p.a.same"), (5, "p.b.same")], "id bigint, qualified_name string")
    calls = spark.createDataFrame([(1, "p.app.main", "util.load"), (2, "p.app.main", "run"), (3, "p.app.main", "only"), (4, "p.app.main", "same"), (5, "p.app.main", "none")], "call_id bigint, module string, callee string")
    imports = spark.createDataFrame([("p.app.main", "util", "p.lib.util"), ("p.app.main", "b", "p.b")], "module string, local_name string, target string")
    got = {r.call_id: (r.target_id, r.strategy, round(r.confidence, 3)) for r in derive.resolve_names(calls, nodes, imports).collect()}
    assert got == {1: (1, "import_map", 0.95), 2: (2, "same_module", 0.9), 3: (3, "unique_name", 0.375), 4: (5, "suffix_match", 0.55)}
    common = spark.createDataFrame([(i, f"p.m{i:04}.get") for i in range(600)] + [(1000, "p.lib.x.deep.load")], "id bigint, qualified_name string")
    asked = spark.createDataFrame([(1, "p.app", "get"), (2, "p.app", "util.deep.load"), (3, "p.app", "deep.load")], "call_id bigint, module string, callee string")
    got = {r.call_id: (r.target_id, r.strategy, round(r.confidence, 6)) for r in derive.resolve_names(asked, common, spark.createDataFrame([("p.app", "util", "p.lib")], "module string, local_name string, target string")).collect()}
    assert got == {1: (0, "suffix_match", round(0.55 * 3 / 600 / 2, 6)), 2: (1000, "import_map_suffix", 0.85), 3: (1000, "qualified_suffix", 0.9)}


def test_config_links(spark):
    n, _ = graph(spark, [(1, "Variable", "max-retries", "p.k", "conf.yaml", 1, 1, "{}"), (2, "Variable", "db", "p.d", "conf.yaml", 1, 1, "{}"), fn(3, "maxRetries"), fn(4, "getMaxRetriesNow"), fn(5, "other")], [])
    assert sorted((r.source_id, r.target_id, r.confidence) for r in derive.config_links(n).collect()) == [(3, 1, 0.85), (4, 1, 0.75)]


def test_coupling(spark):
    c = spark.createDataFrame([(k, f, k) for k in range(5) for f in (["a", "b"] if k < 4 else ["a"])] + [(9, f"f{i}", 1) for i in range(25)], "commit int, file string, ts int")
    assert [tuple(r) for r in derive.change_coupling(c).collect()] == [("a", "b", 4, 1.0, 3)]


def test_routes_match_by_patterns(spark):
    random.seed(6)
    parts = ["a", "b", "{x}", ":id", ""]
    paths = lambda n: [(i, "/" + "/".join(random.choice(parts) for _ in range(random.randint(1, 4))), random.choice(["GET", "POST", None])) for i in range(n)]
    calls, handlers = paths(60), paths(40)
    canon = lambda p: ["{}" if s.startswith((":", "{")) else s for s in p.split("/")]
    want = set()
    for i, p, m in calls:
        for k, q, n in handlers:
            x, y = canon(p), canon(q)
            if len(x) == len(y) and all(a == b or "{}" in (a, b) for a, b in zip(x, y)) and (m == n or None in (m, n)):
                want.add((i, k))
    got = derive.route_matches(spark.createDataFrame(calls, "call_id int, path string, method string"), spark.createDataFrame(handlers, "handler_id int, path string, method string"))
    assert set(map(tuple, got.collect())) == want and len(want) > 50


def test_routes_and_services(spark):
    calls = spark.createDataFrame([(1, "/users/1", "GET"), (2, "/users/:id/x", "POST")], "call_id int, path string, method string")
    handlers = spark.createDataFrame([(7, "/users/{id}", "ANY"), (8, "/users/{id}/x", "GET"), (9, "/{a}/{b}/x", "post")], "handler_id int, path string, method string")
    assert sorted(map(tuple, derive.route_matches(calls, handlers).collect())) == [(1, 7), (2, 9)]
    services = spark.createDataFrame([(1, {"app": "web"})], "service_id int, selector map<string, string>")
    loads = spark.createDataFrame([(5, "web", None), (6, "db", {"app": "web"}), (7, "x", {"app": "y"})], "workload_id int, name string, labels map<string, string>")
    assert sorted(r.workload_id for r in derive.service_workloads(services, loads).collect()) == [5, 6]
    classes = spark.createDataFrame([(1, "read"), (1, "close"), (2, "read")], "id int, method string")
    faces = spark.createDataFrame([(9, "read"), (9, "close")], "id int, method string")
    assert [tuple(r) for r in derive.implementations(classes, faces).collect()] == [(1, 9)]
    n, e = graph(spark, [fn(1, "TestX", "x_test.go"), fn(2, "helper", "x_test.go"), fn(3, "X", "x.go")], [(1, 3, "CALLS", "{}"), (2, 3, "CALLS", "{}"), (1, 2, "CALLS", "{}")])
    assert [tuple(r) for r in derive.tests_edges(n, e).collect()] == [(1, 3)]
    p = spark.createDataFrame([("lib/a",), ("lib/ab",)], "specifier string")
    m = spark.createDataFrame([("lib", "L"), ("lib/a", "A")], "prefix string, module string")
    assert sorted(map(tuple, derive.longest_prefix(p, m).collect())) == [("lib/a", "A"), ("lib/ab", "L")]


def test_architecture(spark):
    nodes = [(10 + i, "File", f, f"p.{f}", f, 1, 1, "{}") for i, f in enumerate(["a.go", "b.go", "c.go", "d.py", "e.js"])]
    nodes += [(1, "Function", "main", "p.cmd.server.main", "cmd/main.go", 1, 9, '{"is_entry_point":true}'), (2, "Function", "HandleRequest", "p.int.handler.HandleRequest", "handler.go", 1, 9, '{"is_entry_point":true,"route_path":"/api/orders"}')]
    nodes += [(3, "Function", "ProcessOrder", "p.int.service.ProcessOrder", "service.go", 1, 9, "{}"), (4, "Function", "T", "p.int.handler.T", "handler_test.go", 1, 9, '{"is_entry_point":true}'), (5, "Route", "r", "p.r", "r", 1, 1, '{"method":"POST","path":"/api/orders","handler":"HandleRequest"}')]
    n, e = graph(spark, nodes, [(1, 2, "CALLS", "{}"), (2, 3, "CALLS", "{}"), (4, 2, "CALLS", "{}"), (2, 5, "HANDLES", "{}")])
    parts = arch.architecture(n, e, ["all"])
    assert sorted(r.name for r in parts["entry_points"].collect()) == ["HandleRequest", "main"]
    assert sorted((r["from"], r["to"]) for r in parts["boundaries"].collect()) == [("handler", "service"), ("server", "handler")]
    assert {r.language: r.file_count for r in parts["languages"].collect()} == {"Go": 3, "Python": 1, "JavaScript": 1}
    assert tuple(parts["routes"].head()) == ("POST", "/api/orders", "HandleRequest")
    assert {r.package: r.layer for r in parts["layers"].collect()}["handler"] == "api"
    assert parts["hotspots"].head().name == "HandleRequest" and parts["clusters"].count() == 1
    assert set(arch.architecture(n, e, ["overview"])) == set(arch.ASPECTS) - {"file_tree"}
    assert {(r.label, r["count"]) for r in arch.label_schema(n).collect()} >= {("File", 5), ("Route", 1)}


# -- changes


def test_edges_merge(spark):
    _, e = graph(spark, [], [(1, 2, "IMPORTS", '{"local_name":"A"}'), (1, 2, "IMPORTS", '{"local_name":"B"}'), (1, 2, "IMPORTS", '{"local_name":"A"}'), (1, 2, "CALLS", "{}"), (1, 2, "CALLS", '{"b":1}'), (1, 2, "CALLS", '{"a":1}')])
    assert sorted((r.type, r.properties) for r in dml.merge_edges(e).collect()) == [("CALLS", '{"a":1}'), ("IMPORTS", '{"local_name":"A"}'), ("IMPORTS", '{"local_name":"B"}')]


def test_graphs_merge_and_shrink(spark):
    n, e = graph(spark, [fn(1, "a"), fn(2, "b")], [(1, 2, "CALLS", "{}")])
    m, f = graph(spark, [fn(7, "b", "new.go"), fn(8, "c")], [(7, 8, "CALLS", "{}")])
    nodes, edges = dml.merge_graphs(n, e, m, f)
    assert sorted((r.id, r.name, r.file_path) for r in nodes.collect()) == [(1, "a", "a.go"), (2, "b", "new.go"), (8, "c", "a.go")]
    assert sorted((r.source_id, r.target_id) for r in edges.collect()) == [(1, 2), (2, 8)]
    nodes, edges = dml.delete_nodes(nodes, edges, F.col("name") == "b")
    assert nodes.count() == 2 and edges.count() == 0
    folders, links = graph(spark, [(1, "Folder", "a", "p.a", "a", 0, 0, "{}"), (2, "Folder", "b", "p.b", "a/b", 0, 0, "{}"), (3, "Folder", "c", "p.c", "c", 0, 0, "{}"), (4, "File", "f", "p.f", "c/f", 0, 0, "{}")], [(1, 2, "CONTAINS_FOLDER", "{}"), (3, 4, "CONTAINS_FILE", "{}")])
    assert sorted(r.id for r in dml.delete_empty_folders(folders, links)[0].collect()) == [3, 4]
    assert sorted(r.id for r in dml.delete_empty_folders(folders, links, spark.createDataFrame([("c/f",)], "file_path string"))[0].collect()) == [1, 2, 3, 4]
    ranked, moved = dml.dense_ids(n, e)
    assert sorted((r.id, r.name) for r in ranked.collect()) == [(1, "a"), (2, "b")] and moved.count() == 1
    assert dml.plausible(10, 20) and not dml.plausible(40, 100)


def test_selectors(spark):
    paths = spark.createDataFrame([("/x/a/app",), ("/x/b/app",), ("/x/lib",)], "path string")
    assert {r.path: r.selector for r in dml.selectors(paths).collect()} == {"/x/a/app": "a/app", "/x/b/app": "b/app", "/x/lib": "lib"}


def test_summaries(spark):
    text = "## PURPOSE\nFoo\n\n## STACK\nBar\n## OTHER\nstays"
    sections = one(spark, dml.summary_sections(F.lit(text)))
    assert sections == {"PURPOSE": "Foo", "STACK": "Bar\n## OTHER\nstays"}
    assert one(spark, dml.render_summary(dml.summary_sections(F.lit("## PURPOSE\nFoo\n\n## STACK\nBar")))) == "## PURPOSE\nFoo\n\n## STACK\nBar"


def test_deltas(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "k int, v string")
    delta = incremental.snapshot_delta(old, new, ["k"])
    assert sorted(map(tuple, delta.collect())) == [(1, "delete"), (2, "update"), (4, "insert")]
    assert incremental.same_content(incremental.apply_delta(old, delta.join(new, "k", "left"), ["k"]), new) and not incremental.same_content(old, new)
    a = spark.createDataFrame([(1, None, "A"), (2, "x", None), (None, "y", "z")], "k int, a string, b string")
    b = a.select("k", F.col("b").alias("a"), F.col("a").alias("b"))
    assert sorted(map(str, incremental.snapshot_delta(a, b, ["k"]).collect())) == sorted(["Row(k=1, op='update')", "Row(k=2, op='update')", "Row(k=None, op='update')"])
    assert incremental.snapshot_delta(a, a.repartition(3), ["k"]).count() == 0
    nested = spark.createDataFrame([(1, [None, "A"], {"x": 1, "y": 2})], "k int, l array<string>, m map<string, int>")
    moved = spark.createDataFrame([(1, ["A", None], {"y": 2, "x": 1})], "k int, l array<string>, m map<string, int>")
    assert incremental.snapshot_delta(nested, moved, ["k"]).count() == 1 and incremental.same_content(nested.drop("l"), moved.drop("l"))
    assert not incremental.same_content(a, b) and not incremental.same_content(nested, moved)
    assert dml.ordered_digest(a, ["k"]).head() == dml.ordered_digest(a.repartition(4), ["k"]).head() != dml.ordered_digest(b, ["k"]).head()
    store = incremental.Generations(spark, str(tmp_path / "g"))
    assert store.publish({"t": old}, 0) == 1 and store.publish({"t": new}, 1) == 2 and store.read("t", 1).count() == 3
    with pytest.raises(incremental.StaleGeneration):
        store.publish({"t": old}, 1)
    with pytest.raises(incremental.StaleGeneration):
        store.check(1)


def test_one_of_two_publishers_succeeds(spark, tmp_path):
    """Both have seen the same generation and written their drafts before either publishes."""
    one, two = (incremental.Generations(spark, str(tmp_path / "g")) for _ in range(2))
    one.publish({"t": spark.range(1)}, 0)
    drafts = [one.draft({"t": spark.range(2)}), two.draft({"t": spark.range(3)})]
    one.commit(drafts[0], 2)
    with pytest.raises(incremental.StaleGeneration):
        two.commit(drafts[1], 2)
    assert two.latest() == 2 and two.read("t").count() == 2
    assert sorted(p.name for p in (tmp_path / "g").iterdir() if "crc" not in p.name) == ["g=1", "g=2"]


def test_rescue(spark):
    old, edges = graph(spark, [fn(1, "caller", "a.go"), fn(2, "kept", "b.go"), fn(3, "moved", "b.go"), fn(4, "gone", "b.go")], [(1, 2, "CALLS", "{}"), (1, 3, "CALLS", "{}"), (1, 4, "CALLS", "{}"), (1, 2, "SIMILAR_TO", "{}")])
    new, _ = graph(spark, [fn(1, "caller", "a.go"), fn(12, "kept", "b.go"), (13, "Function", "moved", "p.src.sub.moved", "b.go", 1, 9, "{}")], [])
    got = incremental.rescue_inbound(old, edges, new, spark.createDataFrame([("b.go",)], "file_path string")).collect()
    assert sorted((r.source_id, r.target_id, r.type) for r in got) == [(1, 12, "CALLS"), (1, 13, "CALLS")]


def test_stream_of_listings(spark, tmp_path):
    rows = [("p", "a", "h", 1, 1), ("p", "b", "h", 2, 2)]
    schema = "project string, rel_path string, sha256 string, mtime_ns bigint, size bigint"
    stored = spark.createDataFrame([("p", "a", "h", 1, 1), ("p", "c", "h", 1, 1)], schema)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    poller.watch_listings(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda: stored, lambda df, n: seen.extend(map(tuple, df.collect())), once=True).awaitTermination()
    assert sorted(seen) == [("b", "new"), ("c", "deleted")] and poller.interval_s(0) == 5 and poller.interval_s(10**6) == 60


# -- sources


def test_texts(spark):
    t = lambda *xs: spark.createDataFrame([(x,) for x in xs], "text string")
    assert [tuple(r) for r in texts.name_status(t("M\ta.go\nR100\told.go\tnew.go\n")).collect()] == [("M", "a.go", None), ("R", "new.go", "old.go")]
    diff = "diff --git a/x.go b/x.go\n--- a/x.go\n+++ b/x.go\n@@ -1,2 +3,4 @@\n+x\n@@ -9 +12 @@\n+y\n@@ -20,3 +20,0 @@\n-z\n"
    assert [tuple(r) for r in texts.hunks(t(diff)).collect()] == [("x.go", 3, 6), ("x.go", 12, 12), ("x.go", 20, 20)]
    assert [tuple(r) for r in texts.git_log(t("COMMIT:ab12|170\na.go\n\nb.go\nCOMMIT:cd|180\nc.go\n")).collect()] == [("ab12", 170, "a.go"), ("ab12", 170, "b.go"), ("cd", 180, "c.go")]
    f = spark.createDataFrame([(".env", 'API=https://x.io/v1\nSECRET_URL=https://y.io\nDB=postgres://u:p@h/db\nexport B="http://z"\n')], "file_path string, content string")
    assert sorted(r.key for r in texts.env_urls(f).collect()) == ["API", "B"]
    k = spark.createDataFrame([("s.yaml", "kind: Service\nmetadata:\n  name: web\nspec:\n  selector:\n    app: web\n  ports: []\n---\nkind: ConfigMap\nmetadata:\n  name: c\n")], "file_path string, content string")
    assert [(r.kind, r.name) for r in texts.kubernetes(k).collect()] == [("Service", "web"), ("ConfigMap", "c")]
    m = spark.createDataFrame([("a/package.json", '{"dependencies":{"react":"1"}}'), ("go.mod", "module x\nrequire github.com/a/b v1.2.0\n")], "file_path string, content string")
    assert sorted(r.dependency for r in texts.manifests(m).collect()) == ["github.com/a/b", "react"]
    tf = spark.createDataFrame([("m.tf", 'resource "aws_s3" "b" {\n}\nvariable "v" {\n}\n')], "file_path string, content string")
    assert sorted((r.block, r.kind, r.name) for r in texts.terraform(tf).collect()) == [("resource", "aws_s3", "b"), ("variable", None, "v")]


def test_spans(spark):
    span = f"span {texts.SPAN}, service string"
    rows = [((2, [("http.method", "GET"), ("http.url", "https://h/api/x?y")], "10", "30"), "s"), ((2, [("db.system", "pg")], "1", "2"), "s")]
    assert [tuple(r) for r in texts.span_facts(spark.createDataFrame(rows, span)).collect()] == [("GET", "/api/x", None, "s", 20)]


def test_source_tree(spark, tmp_path):
    for name in ("src/a.py", "src/skip/b.py", "node_modules/c.js", "d.log", "keep.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = files.source_tree(spark, str(tmp_path), ["*.log", "!keep.log", "skip/"], content=True).collect()
    assert sorted((r.file_path, r.language, r.content) for r in got) == [("keep.log", None, "x"), ("src/a.py", "Python", "x")]


def test_boundaries_grow_in_proportion(spark):
    """Twice the calls, less than three times the work: rows that the plan's joins and sums put out."""
    def work(n):
        nodes = spark.range(n).select("id", F.concat(F.lit("p.s."), F.col("id") % 200, F.lit(".f")).alias("qualified_name"), F.col("id").cast("string").alias("name"), F.lit("a").alias("file_path"))
        edges = spark.range(4 * n).select((F.col("id") % n).alias("source_id"), ((F.col("id") * 7 + 3) % n).alias("target_id"), F.lit("CALLS").alias("type"))
        begin = time.time()
        assert arch.boundaries(nodes, edges).agg(F.sum("calls")).head()[0] > n
        return time.time() - begin

    work(1000)
    small, large = min(work(40_000) for _ in range(2)), min(work(80_000) for _ in range(2))
    assert large < 3 * small + 1


def test_tools(spark, tmp_path):
    from graphlake.tools import Tools

    n, e = graph(spark, [fn(1, "A"), fn(2, "B", "b.go"), fn(3, "C")], [(1, 2, "CALLS", "{}"), (2, 3, "CALLS", "{}")])
    t = Tools(spark, str(tmp_path))
    assert t.list_projects().count() == 0 and t.index_repository(n, e) == 1
    other = n.withColumn("project", F.lit("q")).withColumn("id", F.col("id") + 10)
    t.index_repository(other, e.limit(0))
    assert sorted((r.project, r.nodes, r.edges) for r in t.list_projects().collect()) == [("p", 3, 2), ("q", 3, 0)]
    assert [r.name for r in t.trace_path("A", "outbound").collect()] == ["B", "C"]
    assert t.query_graph("MATCH (a)-[:CALLS]->(b) RETURN b.name AS n ORDER BY n").collect()[0].n == "B"
    page, total = t.search_graph(search.Search(name="a"), limit=1)
    assert total == 2 and page.count() == 1 and t.search_graph(words="b", projects=["p"])[1] == 1
    diff = spark.createDataFrame([("diff --git a/b.go b/b.go\n--- a/b.go\n+++ b/b.go\n@@ -1 +2 @@\n+x\n",)], "text string")
    changes = t.detect_changes(diff)
    assert [r.name for r in changes["symbols"].filter("project = 'p'").collect()] == ["B"] and changes["summary"].head().critical == 1
    assert t.get_graph_schema()["patterns"].count() == 1 and set(t.get_architecture(["hotspots"])) == {"hotspots"}
    files_ = spark.createDataFrame([("b.go", "one\ntwo\nthree")], "file_path string, content string")
    assert t.search_code(files_, "two").count() >= 1 and t.get_code_snippet(files_, "B").head().source == "one\ntwo\nthree"
    t.manage_adr("p", "put", "## PURPOSE\nFoo")
    assert t.manage_adr("p", section="PURPOSE").head().text == "Foo"
    with pytest.raises(ValueError):
        t.manage_adr("p", "put", "nothing known")
    t.manage_adr("p", "delete")
    assert t.manage_adr("p").count() == 0
    assert t.index_status("p", 100).head().plausible is False and t.delete_project("p") == 3 and t.list_projects().count() == 1
    span = spark.createDataFrame([((2, [("http.method", "GET"), ("http.url", "https://h/a")], "10", "30"), "s")], f"span {texts.SPAN}, service string")
    assert tuple(t.ingest_traces(span).head()) == ("GET", "/a", 1, 20)


def test_cross_project_edges_come_once(spark):
    """Ends with several common keys, ends that call and handle, keys of many pairs, null keys and projects."""
    rng = random.Random(5)
    ends = [[(rng.choice(["p", "q", "r", None]), rng.randrange(12), rng.choice(["x", "y", "z", None])) for _ in range(90)] for _ in range(2)]
    ends[0] += [("s", 100 + i, "hot") for i in range(50)]
    ends[1] += [("t", 200 + i, "hot") for i in range(50)]
    want = set()
    for pa, a, k in ends[0]:
        for pb, b, m in ends[1]:
            if k is not None and k == m and None not in (pa, pb) and pa != pb:
                want |= {(pa, a, b, pb), (pb, b, a, pa)}
    callers, handlers = (spark.createDataFrame(rows, "project string, id bigint, key string") for rows in ends)
    got = [(r.project, r.source_id, r.target_id, r.target_project) for r in derive.cross_project(callers, handlers).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_cross_project_shuffles_ends_not_pairs(spark):
    """Ends with one key each make no pair twice, so no pair is grouped."""
    ends = [spark.range(40).select(F.lit(p).alias("project"), (F.col("id") + k).alias("id"), (F.col("id") % 3).alias("key")) for p, k in (("a", 0), ("b", 1000))]
    df = derive.cross_project(*ends)
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count() == 2 * (14 * 14 + 13 * 13 + 13 * 13)


def test_rounds_carry_no_estimates(spark):
    """The size that a plan is taken for does not grow from round to round, as products of joins did."""
    one = spark.range(3).withColumn("v", F.col("id"))
    df = communities.cut(one)
    sizes = []
    for _ in range(3):
        df = communities.cut(df.join(df.select("id", F.col("v").alias("w")), "id").select("id", F.greatest("v", "w").alias("v")))
        sizes.append(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert len(set(sizes)) == 1 and sorted(map(tuple, df.collect())) == [(0, 0), (1, 1), (2, 2)]
