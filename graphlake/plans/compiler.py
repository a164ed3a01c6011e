"""Tree to DataFrame. Every clause adds to one lazy plan; only long variable-length paths run step by step.

A variable's fields are flat columns `variable__field`, and a scan holds just the fields that the query names, so
filters and column pruning reach the files. Missing values are null: a condition on one is not true.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators.traverse import reach
from . import tree as t
from .parser import AGGREGATES, QueryError, parse

#: What RETURN * shows of a node.
SHOWN = ("name", "qualified_name", "label", "file_path")
#: The fields that keys() looks at.
KEYS = ("name", "qualified_name", "label", "file_path", "start_line", "end_line")
_REGEX_MARKS = (".*", ".+", "[", "(", "|", "^", "$")


def _col(var: str, field: str) -> Column:
    return F.col(f"`{var}__{field}`")


class Compiler:
    def __init__(self, graph: PropertyGraph, functions: dict[str, Callable] | None = None, depth: int | None = None, compat: bool = False) -> None:
        self.graph, self.functions, self.depth, self.compat = graph, {k.lower(): f for k, f in (functions or {}).items()}, depth, compat

    def compile(self, text: str) -> DataFrame:
        return self.query(parse(text, set(self.functions), self.depth))

    def query(self, q: t.Query) -> DataFrame:
        df = self.branch(q)
        while q.union:
            kind, q = q.union
            other = self.branch(q)
            if len(other.columns) != len(df.columns):
                raise QueryError("the branches of a UNION must have as many columns")
            df = df.union(other.toDF(*df.columns))
            df = df if kind == "all" else df.distinct()
        return df

    # -- one branch

    def branch(self, q: t.Query) -> DataFrame:
        self.kinds: dict[str, str] = {}  # variable -> node, edge, path or value
        self.texts: dict[tuple[int, object], bool] = {}  # is an expression over a table text?
        self.bound: set[str] = set()
        self.needs = self._needs(q)
        self.weight = False  # does a column _n say how many matches a row stands for?
        df = self.counted(q)
        if df is not None:
            return self.project(df, q.returned, keep=False)
        for c in q.clauses:
            if isinstance(c, t.Match):
                df = self.match(df, c)
            elif isinstance(c, t.Unwind):
                df = self.unwind(df, c)
            else:
                df = self.project(df, c.projection, keep=True)
                df = df if c.where is None else self.filter(df, c.where)
        if df is None:
            df = self.graph.spark.range(1).select()
        if q.returned is None:
            first = next(c for c in q.clauses if isinstance(c, t.Match)).paths[0]
            items = [t.Item(t.Property(n.name, f), None) for n in first.nodes for f in ("name", "qualified_name", "label")]
            return self.project(df, t.Projection(tuple(items)), keep=False)
        return self.project(df, q.returned, keep=False)

    def _needs(self, q: t.Query) -> dict[str, set[str]]:
        """The fields of each variable that some clause reads; a name passed on by WITH hands its needs back."""
        needs: dict[str, set[str]] = {}
        passed: list[tuple[str, str]] = []
        names: set[str] = set()
        for c in q.clauses:
            if isinstance(c, t.Match):
                names |= {n.name for p in c.paths for n in p.nodes} | {e.name for p in c.paths for e in p.edges if e.name}
                for p in c.paths:
                    for n in p.nodes:
                        needs.setdefault(n.name, set()).update(k for k, _ in n.values)
        shows = [c.projection for c in q.clauses if isinstance(c, t.With)] + ([q.returned] if q.returned else [])
        for x in t.walk((q.clauses, q.returned)):
            if isinstance(x, t.Property):
                needs.setdefault(x.name, set()).add(x.key)
            elif isinstance(x, t.HasLabel):
                needs.setdefault(x.name, set()).add("label")
            elif isinstance(x, t.Call):
                for a in x.args:
                    if isinstance(a, t.Name):
                        own = {"labels": {"label"}, "type": {"type"}, "keys": set(KEYS), "properties": {"properties"}, "id": set()}
                        needs.setdefault(a.name, set()).update(own.get(x.name, {"name"} if x.name == "collect" else set()))
            elif isinstance(x, t.Item) and isinstance(x.of, t.Name):
                passed.append((x.of.name, x.title))
        # a label that a pattern asks of a variable matched before must be at hand
        seen: set[str] = {new for _, new in passed}
        for n in t.walk((q.clauses, q.returned)):
            if isinstance(n, t.NodePattern):
                if n.labels:
                    needs.setdefault(n.name, set()).update({"label"} if n.name in seen else set())
                seen.add(n.name)
        returned = q.returned
        if returned is None and q.clauses:
            first = next((c for c in q.clauses if isinstance(c, t.Match)), None)
            for n in first.paths[0].nodes if first else ():
                needs.setdefault(n.name, set()).update(("name", "qualified_name", "label"))
        if returned:
            for i in returned.items:
                if isinstance(i.of, t.Name):
                    needs.setdefault(i.of.name, set()).update(("name", "properties"))
        if any(s.star for s in shows):
            for n in names:
                needs.setdefault(n, set()).update((*SHOWN, "type"))
        for key, _ in [o for s in shows for o in s.order]:
            if isinstance(key, t.Name):
                needs.setdefault(key.name, set()).add("name")
        for _ in range(len(passed) + 1):
            for old, new in passed:
                needs.setdefault(old, set()).update(needs.get(new, set()))
        return needs

    # -- counts of cyclic patterns

    def counted(self, q: t.Query) -> DataFrame | None:
        """The returned nodes with the number of their matches as _n, for a pattern with a cycle of which only count(*) is asked.

        Walking around a cycle lists every way through it before its ends are compared. Here a variable that is not
        returned is summed away as soon as its own edges are joined: first those next to returned ones, so tables stay
        as small as pairs of a node and what is returned. None: the query is of another kind.
        """
        if q.returned is None or q.returned.star or any(not isinstance(c, t.Match) or c.optional or c.where is not None for c in q.clauses):
            return None
        paths = [p for c in q.clauses for p in c.paths]
        used = list(t.walk((tuple(i.of for i in q.returned.items), tuple(key for key, _ in q.returned.order))))
        sums = [x for x in used if isinstance(x, t.Call) and x.name in AGGREGATES]
        if not sums or any(not x.star for x in sums) or any(isinstance(x, t.Exists) for x in used) or any(e.name or e.variable or e.direction == "any" for p in paths for e in p.edges):
            return None
        nodes: dict[str, list[t.NodePattern]] = {}
        starts: list[str] = []
        for p in paths:
            if not any(n.name in nodes for n in p.nodes):
                starts.append(p.nodes[0].name)
            for n in p.nodes:
                nodes.setdefault(n.name, []).append(n)
        links = [(a.name, e, b.name) if e.direction == "out" else (b.name, e, a.name) for p in paths for a, e, b in zip(p.nodes, p.edges, p.nodes[1:])]
        titles = {i.title for i in q.returned.items}
        kept = {x.name for i in q.returned.items for x in t.walk(i.of) if isinstance(x, (t.Property, t.Name, t.HasLabel))}
        other = {x.name for key, _ in q.returned.order for x in t.walk(key) if isinstance(x, (t.Property, t.Name, t.HasLabel))} - titles
        # a connected pattern has a cycle if it has as many edges as nodes
        if not (kept | other) <= set(nodes) or len(starts) != 1 or len(links) < len(nodes) or any(a == b for a, _, b in links) or {"in_degree", "out_degree"} & set().union(*(self.needs.get(n, set()) for n in nodes)):
            return None
        labels: dict[str, set[str] | None] = {}
        for name, said in nodes.items():
            asked = [set(n.labels) for n in said if n.labels]
            labels[name] = set.intersection(*asked) if asked else None
        factors: list[tuple[list[str], DataFrame]] = []
        for a, e, b in links:
            tables = self.graph.edge_ends(e.types or None)
            if tables is None:
                return None
            keep = [x for x in tables if (labels[a] is None or x.source in labels[a]) and (labels[b] is None or x.target in labels[b])]
            factors.append(([a, b], self._edges_of(keep, []).select(F.col("source_id").alias(f"{a}__id"), F.col("target_id").alias(f"{b}__id"), F.lit(1).cast("bigint").alias("_n"))))
        scans: dict[str, DataFrame] = {}
        for name, said in nodes.items():
            values = tuple(v for n in said for v in n.values)
            if name in starts or name in kept or values or [f for f in self.fields(name) if f != "label"]:
                scans[name] = self.scan(t.NodePattern(name, tuple(sorted(labels[name] or ())), values))
            self.kinds[name] = "node"
        for name in nodes:
            if name in scans and name not in kept:
                factors.insert(0, ([name], scans[name].select(f"{name}__id", F.lit(1).cast("bigint").alias("_n"))))
        left = [n for n in nodes if n not in kept]
        while left:
            near = {v: {n for names, _ in factors if v in names for n in names} - {v} for v in left}
            v = min(left, key=lambda v: (-len(near[v] & kept), len(near[v]), left.index(v)))
            left.remove(v)
            own = sorted((f for f in factors if v in f[0]), key=lambda f: len(f[0]))
            factors = [f for f in factors if v not in f[0]]
            factors.append(self._summed(self._met(own), sorted(near[v])))
        df = self._met(factors)[1]
        for name in sorted(kept):
            df = df.join(scans[name], f"{name}__id")
        self.bound, self.weight = set(kept), True
        return df

    @staticmethod
    def _met(factors: list[tuple[list[str], DataFrame]]) -> tuple[list[str], DataFrame]:
        """The join of tables (variables, rows) on the variables they share; those that share one go first. Numbers of matches multiply."""
        (names, df), rest = factors[0], list(factors[1:])
        while rest:
            f = max(rest, key=lambda f: len(set(f[0]) & set(names)))
            rest.remove(f)
            more, shared = f[1].withColumnRenamed("_n", "_m"), [f"{n}__id" for n in f[0] if n in names]
            df = (df.join(more, shared) if shared else df.crossJoin(more)).withColumn("_n", F.col("_n") * F.col("_m")).drop("_m")
            names = names + [n for n in f[0] if n not in names]
        return names, df

    @staticmethod
    def _summed(factor: tuple[list[str], DataFrame], names: list[str]) -> tuple[list[str], DataFrame]:
        rows = factor[1].groupBy(*(f"{n}__id" for n in names)).agg(F.sum("_n").alias("_n"))
        return names, rows if names else rows.select(F.coalesce("_n", F.lit(0)).alias("_n"))

    # -- matching

    def match(self, df: DataFrame | None, m: t.Match) -> DataFrame:
        if not m.optional or df is None:
            for p in m.paths:
                df = self.path(df, p)
            return df if m.where is None else self.filter(df, m.where)
        before = set(self.bound)
        used = {x.name for x in t.walk((m.paths, m.where)) if isinstance(x, (t.NodePattern, t.EdgePattern, t.Property, t.Name, t.HasLabel)) and x.name in before}
        keys = [c for c in df.columns if c.split("__")[0] in used]
        base = df.select(*(f"`{c}`" for c in keys)).distinct() if keys else None
        self.bound = set(used)
        sub = base
        for p in m.paths:
            sub = self.path(sub, p)
        sub = sub if m.where is None else self.filter(sub, m.where)
        new = self.bound - used
        self.bound |= before
        if not keys:
            return df.join(sub, F.lit(True), "left")
        renamed = sub.select(*(F.col(f"`{c}`").alias(f"_key_{i}") for i, c in enumerate(keys)), *(f"`{c}`" for c in sub.columns if c.split("__")[0] in new))
        on = reduce(lambda a, b: a & b, (F.col(f"`{c}`").eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(keys)))
        return df.join(renamed, on, "left").drop(*(f"_key_{i}" for i in range(len(keys))))

    def path(self, df: DataFrame | None, p: t.Path) -> DataFrame:
        at = next((i for i, n in enumerate(p.nodes) if n.name in self.bound), None)
        if at is None:
            at = 0
            start = self.scan(p.nodes[0])
            if df is not None:
                # no variable in common: every row with every match, as the pattern asks
                held, self.bound = self.bound, set()
                self.bound.add(p.nodes[0].name)
                alone = self.spread(start, p, 0)
                self.bound |= held
                return df.crossJoin(alone)
            df = start
            self.bound.add(p.nodes[0].name)
        else:
            df = self.narrow(df, p.nodes[at])
        return self.spread(df, p, at)

    def spread(self, df: DataFrame, p: t.Path, at: int) -> DataFrame:
        for i in range(at, len(p.edges)):
            df = self.expand(df, p.nodes[i], p.edges[i], p.nodes[i + 1], False)
        for i in range(at - 1, -1, -1):
            df = self.expand(df, p.nodes[i + 1], p.edges[i], p.nodes[i], True)
        return df

    def fields(self, name: str) -> list[str]:
        return sorted(self.needs.get(name, set()) - {"id", "in_degree", "out_degree", "type"})

    def scan(self, n: t.NodePattern) -> DataFrame:
        self.kinds[n.name] = "node"
        fields = self.fields(n.name)
        df = self.graph.node_scan(n.labels or None, fields)
        df = df.select(F.col("id").alias(f"{n.name}__id"), F.col("label").alias(f"{n.name}__label"), *(F.col(f"`{f}`").alias(f"{n.name}__{f}") for f in fields if f != "label"))
        df = self.values(df, n)
        for side, end in (("in_degree", "target_id"), ("out_degree", "source_id")):
            if side in self.needs.get(n.name, set()):
                counts = self.graph.edge_scan(["CALLS"], []).groupBy(F.col(end).alias("_end")).agg(F.count("*").alias("_n"))
                df = df.join(counts, F.col(f"`{n.name}__id`") == F.col("_end"), "left").withColumn(f"{n.name}__{side}", F.coalesce("_n", F.lit(0))).drop("_end", "_n")
        return df

    def values(self, df: DataFrame, n: t.NodePattern) -> DataFrame:
        """The inline map: text with marks of a pattern is searched for, other values are equal."""
        for key, value in n.values:
            if not isinstance(value, t.Literal):
                raise QueryError("values in a node pattern must be literals")
            if isinstance(value.value, str) and any(m in value.value for m in _REGEX_MARKS):
                df = df.filter(_col(n.name, key).cast("string").rlike(value.value))
            else:
                df = df.filter(self.compare(df, "=", t.Property(n.name, key), value))
        return df

    def narrow(self, df: DataFrame, n: t.NodePattern) -> DataFrame:
        """What a bound variable's pattern asks beyond its name."""
        if n.labels:
            df = df.filter(_col(n.name, "label").isin(*n.labels))
        return self.values(df, n)

    def expand(self, df: DataFrame, a: t.NodePattern, e: t.EdgePattern, b: t.NodePattern, back: bool) -> DataFrame:
        """Joins the edges from a and their far nodes b. back: the pattern reads b first."""
        direction = e.direction if e.direction == "any" or not back else {"out": "in", "in": "out"}[e.direction]
        fields = sorted(self.needs.get(e.name, set()) - {"type", "id", "name"}) if e.name and not e.variable else []
        tables = self.graph.edge_ends(e.types or None)
        implied = False
        if tables is not None and direction != "any" and not e.variable:
            near, far = ("source", "target") if direction == "out" else ("target", "source")
            keep = [x for x in tables if (not a.labels or getattr(x, near) in a.labels) and (not b.labels or getattr(x, far) in b.labels)]
            edges = self._edges_of(keep, fields)
            implied = True
        else:
            edges = self.graph.edge_scan(e.types or None, fields, repeated=e.variable)
        ends = ("source_id", "target_id") if direction != "in" else ("target_id", "source_id")
        r = e.name or "_edge"
        told = [F.col("type").alias(f"{r}__type"), *(F.col(f"`{f}`").alias(f"{r}__{f}") for f in fields)] if e.name and not e.variable else []
        own = edges.select(F.col(ends[0]).alias("_from"), F.col(ends[1]).alias("_to"), *told)
        if direction == "any":
            own = own.unionByName(edges.select(F.col(ends[1]).alias("_from"), F.col(ends[0]).alias("_to"), *told))
        if e.name:
            self.kinds[e.name] = "path" if e.variable else "edge"
            if not e.variable:
                self.bound.add(e.name)
        if e.variable:
            own = reach(df.select(F.col(f"`{a.name}__id`").alias("seed")).filter("seed is not null").distinct(), own.select("_from", "_to"), e.least, e.most).select(F.col("seed").alias("_from"), F.col("node").alias("_to"))
        if b.name in self.bound:
            df = df.join(own, (_col(a.name, "id") == F.col("_from")) & (_col(b.name, "id") == F.col("_to"))).drop("_from", "_to")
            return self.narrow(df, b)
        df = df.join(own, _col(a.name, "id") == F.col("_from")).drop("_from")
        self.bound.add(b.name)
        self.kinds[b.name] = "node"
        wanted = self.fields(b.name)
        degrees = {"in_degree", "out_degree"} & self.needs.get(b.name, set())
        if implied and not [f for f in wanted if f != "label"] and not b.values and not degrees and "label" not in wanted:
            return df.withColumnRenamed("_to", f"{b.name}__id")
        return df.join(self.scan(b), F.col("_to") == _col(b.name, "id")).drop("_to")

    def _edges_of(self, tables: list, fields: list[str]) -> DataFrame:
        return PropertyGraph(project=self.graph.project, edge_tables=tuple(tables), spark=self.graph.spark).edge_scan(None, fields)

    def unwind(self, df: DataFrame | None, u: t.Unwind) -> DataFrame:
        df = self.graph.spark.range(1).select() if df is None else df
        self.kinds[u.name] = "value"
        self.bound.add(u.name)
        return df.withColumn(f"{u.name}__value", F.explode(self.expression(df, u.of)))

    # -- filters

    def filter(self, df: DataFrame, where: object) -> DataFrame:
        """Conjuncts one by one: EXISTS alone becomes a semi or anti join."""
        if isinstance(where, t.Binary) and where.op == "and":
            return self.filter(self.filter(df, where.left), where.right)
        inner, negated = (where.of, True) if isinstance(where, t.Unary) and where.op == "not" else (where, False)
        if isinstance(inner, t.Exists):
            found, keys = self.exists(df, inner)
            return df.join(found, self._same(keys), "left_anti" if negated else "left_semi")
        columns = df.columns
        parts = list(dict.fromkeys(x for x in t.walk(where) if isinstance(x, t.Exists)))
        marks = {}
        for i, x in enumerate(parts):
            found, keys = self.exists(df, x)
            df = df.join(found.withColumn(f"_exists{i}", F.lit(True)), self._same(keys), "left").drop(*(f"_key_{k}" for k in range(len(keys))))
            marks[x] = F.coalesce(F.col(f"_exists{i}"), F.lit(False))
        self.marks = marks
        df = df.filter(self.expression(df, where))
        return df.select(*(f"`{c}`" for c in columns)) if parts else df

    @staticmethod
    def _same(keys: list[str]) -> Column:
        return reduce(lambda a, b: a & b, (F.col(f"`{c}`") == F.col(f"_key_{i}") for i, c in enumerate(keys)))

    def exists(self, df: DataFrame, e: t.Exists) -> tuple[DataFrame, list[str]]:
        """The ids of bound variables for which the pattern has a match, as _key_0 ..., and their columns."""
        shared = [n.name for n in e.path.nodes if n.name in self.bound]
        if not shared:
            raise QueryError("EXISTS needs a variable that is matched outside")
        held, kinds, needs = set(self.bound), dict(self.kinds), {k: set(v) for k, v in self.needs.items()}
        for x in t.walk((e.path, e.where)):
            if isinstance(x, t.Property) and x.name not in held:
                self.needs.setdefault(x.name, set()).add(x.key)
        used = set(shared) | {x.name for x in t.walk(e.where) if isinstance(x, (t.Property, t.Name)) and x.name in held}
        self.bound = set(used)
        base = df.select(*(f"`{c}`" for c in df.columns if c.split("__")[0] in used)).distinct()
        sub = self.path(base, e.path)
        sub = sub if e.where is None else self.filter(sub, e.where)
        keys = [f"{n}__id" for n in dict.fromkeys(shared)]
        found = sub.select(*(F.col(f"`{c}`").alias(f"_key_{i}") for i, c in enumerate(keys))).distinct()
        self.bound, self.kinds, self.needs = held, kinds, needs
        return found, keys

    # -- projection

    def project(self, df: DataFrame, p: t.Projection, keep: bool) -> DataFrame:
        """RETURN, or with keep WITH: nodes and edges stay what they are under their new names."""
        items = list(p.items)
        if p.star:
            if keep:
                items = [t.Item(t.Name(n), n) for n in sorted(self.bound) if not n.startswith("_anonymous")] + items
            else:
                star = [t.Item(t.Property(n, f), f"{n}.{f}") for n in sorted(self.bound) if not n.startswith("_anonymous") for f in (SHOWN if self.kinds[n] == "node" else ("type",) if self.kinds[n] == "edge" else ("value",))]
                items = star + items
        aggregated = any(isinstance(x, t.Call) and x.name in AGGREGATES for i in items for x in t.walk(i.of))
        outputs: list[tuple[str, Column, bool]] = []  # column, expression, is a key
        kinds: dict[str, str] = {}
        for i in items:
            alias = i.title
            if keep and isinstance(i.of, t.Name) and self.kinds.get(i.of.name) in ("node", "edge", "value"):
                old = i.of.name
                kinds[alias] = self.kinds[old]
                outputs += [(f"{alias}__{c.split('__', 1)[1]}", F.col(f"`{c}`"), True) for c in df.columns if c.split("__")[0] == old]
                continue
            kinds[alias] = "value"
            inner = any(isinstance(x, t.Call) and x.name in AGGREGATES for x in t.walk(i.of))
            outputs.append((f"{alias}__value" if keep else alias, self.expression(df, i.of), not inner))
        order: list[Column] = []
        hidden: list[tuple[str, Column]] = []
        for n, (key, down) in enumerate(p.order):
            match = next((i for i in items if i.of == key or (isinstance(key, t.Name) and i.title == key.name)), None)
            if match is None and isinstance(key, t.Property) and next((i for i in items if i.title == f"{key.name}.{key.key}"), None):
                match = next(i for i in items if i.title == f"{key.name}.{key.key}")
            if match is not None and not (keep and kinds[match.title] != "value"):
                column = F.col(f"`{match.title}__value`" if keep else f"`{match.title}`")
            elif match is not None:
                column = F.col(f"`{match.title}__id`")
            elif keep and isinstance(key, t.Property) and f"{key.name}__{key.key}" in [o[0] for o in outputs]:
                column = _col(key.name, key.key)
            else:
                if aggregated or p.distinct:
                    raise QueryError("ORDER BY after an aggregate or DISTINCT must name a returned item")
                hidden.append((f"_order{n}", self.expression(df, key)))
                column = F.col(f"_order{n}")
            order.append(column.desc() if down else column.asc())
        names = [o[0] for o in outputs]
        if len(set(names)) != len(names):
            raise QueryError("two returned items have the same name; use AS")
        if aggregated:
            keys = [e.alias(n) for n, e, is_key in outputs if is_key]
            sums = [e.alias(n) for n, e, is_key in outputs if not is_key]
            if self.compat and not keys:
                df = df.groupBy().agg(*sums, F.count("*").alias("_rows")).filter("_rows > 0").select(*(f"`{n}`" for n in names))
            else:
                df = (df.groupBy(*keys) if keys else df.groupBy()).agg(*sums).select(*(f"`{n}`" for n in names))
        else:
            df = df.select(*(e.alias(n) for n, e, _ in outputs), *(e.alias(n) for n, e in hidden))
        if p.distinct and not self.compat:
            df = df.distinct()
        if order:
            df = df.orderBy(*order)
        if p.skip:
            df = df.offset(p.skip)
        if p.limit is not None:
            df = df.limit(p.limit)
        if p.distinct and self.compat:
            df = df.distinct()
        if keep:
            self.kinds, self.bound = kinds, set(kinds)
        elif self.compat:
            shown = dict(df.dtypes)
            df = df.select(*((F.coalesce(F.col(f"`{n}`"), F.lit("")) if shown[n] == "string" else F.col(f"`{n}`")).alias(n) for n in df.columns))
        return df.drop(*(n for n, _ in hidden)) if hidden else df

    # -- expressions

    def expression(self, df: DataFrame, e: object) -> Column:
        if isinstance(e, t.Literal):
            return F.lit(e.value)
        if isinstance(e, t.ListOf):
            return F.array(*(self.expression(df, x) for x in e.items))
        if isinstance(e, t.Name):
            kind = self.kind(e.name)
            return _col(e.name, {"node": "name", "edge": "properties", "value": "value"}[kind])
        if isinstance(e, t.Property):
            if self.kind(e.name) == "path":
                raise QueryError(f"{e.name} is a path of several edges and has no properties")
            if self.kinds[e.name] == "value":
                return _col(e.name, "value") if e.key == "value" else F.get_json_object(_col(e.name, "value"), f"$.{e.key}")
            return _col(e.name, e.key)
        if isinstance(e, t.HasLabel):
            self.kind(e.name)
            return _col(e.name, "label").isin(*e.labels)
        if isinstance(e, t.Exists):
            return self.marks[e]
        if isinstance(e, t.Unary):
            of = self.expression(df, e.of)
            return {"not": lambda: ~of, "-": lambda: -of, "is null": of.isNull, "is not null": of.isNotNull}[e.op]()
        if isinstance(e, t.Case):
            out = None
            for when, then in e.branches:
                test = self.expression(df, when) if e.subject is None else self.compare(df, "=", e.subject, when)
                value = self.expression(df, then)
                out = F.when(test, value) if out is None else out.when(test, value)
            return out if e.default is None else out.otherwise(self.expression(df, e.default))
        if isinstance(e, t.Call):
            return self.call(df, e)
        left = lambda: self.expression(df, e.left)
        right = lambda: self.expression(df, e.right)
        if e.op in ("and", "or"):
            return left() & right() if e.op == "and" else left() | right()
        if e.op == "xor":
            return left() != right()
        if e.op in ("=", "<>", "<", ">", "<=", ">="):
            return self.compare(df, e.op, e.left, e.right)
        if e.op == "in":
            if not isinstance(e.right, t.ListOf):
                return F.array_contains(right(), left())
            if all(isinstance(x, t.Literal) for x in e.right.items):
                numbers = any(isinstance(x.value, (int, float)) and not isinstance(x.value, bool) for x in e.right.items)
                own = left()
                if numbers and self.is_text(df, e.left):
                    own = left().try_cast("double")
                return own.isin(*(x.value for x in e.right.items))
            return reduce(lambda a, b: a | b, (self.compare(df, "=", e.left, x) for x in e.right.items), F.lit(False))
        if e.op == "=~":
            return self.search(left().cast("string"), e.right)
        text = {"contains": lambda: left().contains(right()), "starts with": lambda: left().startswith(right()), "ends with": lambda: left().endswith(right())}
        if e.op in text:
            return text[e.op]()
        if e.op == "+" and (self.is_text(df, e.left) or self.is_text(df, e.right)):
            return F.concat(left().cast("string"), right().cast("string"))
        return {"+": lambda: left() + right(), "-": lambda: left() - right(), "*": lambda: left() * right(), "/": lambda: F.try_divide(left(), right()), "%": lambda: F.try_mod(left(), right())}[e.op]()

    def kind(self, name: str) -> str:
        if name not in self.kinds:
            raise QueryError(f"unknown variable {name}")
        return self.kinds[name]

    def is_text(self, df: DataFrame, e: object) -> bool:
        if isinstance(e, t.Literal):
            return isinstance(e.value, str)
        key = (id(df), e)
        if key not in self.texts:
            # the type is asked of an empty table with the same columns, not of the whole plan
            empty = self.graph.spark.createDataFrame([], df.schema)
            self.texts[key] = empty.select(self.expression(df, e)).schema[0].dataType.simpleString() == "string"
        return self.texts[key]

    def compare(self, df: DataFrame, op: str, left: object, right: object) -> Column:
        """Typed comparison: text beside a number or truth value is read as one, and is null if it is none."""
        a, b = self.expression(df, left), self.expression(df, right)
        for one, other in ((left, right), (right, left)):
            if isinstance(other, t.Literal) and not isinstance(one, t.Literal) and not isinstance(other.value, str) and other.value is not None and self.is_text(df, one):
                kind = "boolean" if isinstance(other.value, bool) else "double"
                a, b = (a.try_cast(kind), b) if one is left else (a, b.try_cast(kind))
        return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    @staticmethod
    def search(text: Column, pattern: object) -> Column:
        """An unanchored search; a plain word with or without anchors becomes a comparison that files can use."""
        if not isinstance(pattern, t.Literal) or not isinstance(pattern.value, str):
            raise QueryError("=~ needs a literal pattern")
        said = pattern.value
        core = said.removeprefix("^").removesuffix("$")
        if core and all(c.isalnum() or c in " _-/" for c in core):
            if said.startswith("^") and said.endswith("$"):
                return text == core
            return text.startswith(core) if said.startswith("^") else text.endswith(core) if said.endswith("$") else text.contains(core)
        return text.rlike(said)

    def call(self, df: DataFrame, c: t.Call) -> Column:
        if c.star:
            return F.coalesce(F.sum("_n"), F.lit(0)) if self.weight else F.count("*")
        first = c.args[0] if c.args else None
        named = first.name if isinstance(first, t.Name) else None
        entity = named is not None and self.kind(named) in ("node", "edge")
        if c.name in self.functions:
            return self.functions[c.name](*(self.expression(df, a) for a in c.args))
        arity = {"substring": (2, 3), "left": (2, 2), "right": (2, 2), "replace": (3, 3), "coalesce": (1, 99)}.get(c.name, (1, 1))
        if not arity[0] <= len(c.args) <= arity[1]:
            raise QueryError(f"{c.name} takes {arity[0]} to {arity[1]} arguments")
        if c.name in ("labels", "type", "id", "keys", "properties"):
            if not entity:
                raise QueryError(f"{c.name} needs a node or an edge")
            if c.name == "labels":
                return F.array(_col(named, "label"))
            if c.name == "keys":
                return F.filter(F.array(*(F.when(_col(named, k).isNotNull(), F.lit(k)) for k in KEYS)), lambda x: x.isNotNull())
            return _col(named, c.name)
        if c.name == "count" and entity:
            x = _col(named, "id" if self.kinds[named] == "node" else "type")
            return F.count_distinct(x) if c.distinct else F.count(x)
        x = self.expression(df, first)
        if c.name in AGGREGATES:
            plain = {"count": (lambda v: F.count(F.lit(1))) if self.compat else F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": lambda v: F.array_sort(F.collect_list(v))}
            unlike = {"count": F.count_distinct, "sum": F.sum_distinct, "avg": lambda v: F.try_divide(F.sum_distinct(v), F.count_distinct(v)), "min": F.min, "max": F.max, "collect": lambda v: F.array_sort(F.collect_set(v))}
            return (unlike if c.distinct else plain)[c.name](x)
        from ..functions import scalar

        rest = [self.expression(df, a) for a in c.args[1:]]
        return scalar.QUERY_FUNCTIONS[c.name](x, *rest)


def run(graph: PropertyGraph, text: str, functions: dict[str, Callable] | None = None, max_rows: int | None = None, depth: int | None = None, compat: bool = False) -> DataFrame:
    """The rows of a query. functions: more scalar functions by name; max_rows: a ceiling, one row past it raises.

    depth: the longest path that variable lengths are taken for, as some engines clamp it; without it every length is exact.
    compat: missing text is shown as empty, count(x) counts rows, aggregates of nothing give no row, and DISTINCT comes
    after LIMIT, as engines have it in which everything is text.
    """
    df = Compiler(graph, functions, depth, compat).compile(text)
    if max_rows is None:
        return df
    if df.limit(max_rows + 1).count() > max_rows:
        raise QueryError(f"the result exceeds {max_rows} rows")
    return df
