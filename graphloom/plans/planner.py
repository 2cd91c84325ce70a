"""From syntax to DataFrames.

A state is a frame and a scope.  Every clause maps one state to the next, so the
whole query is one lazy plan for the optimizer.  A node variable ``n`` owns the
columns ``n__nid``, ``n__id``, ``n__kind`` and ``n__p_<property>`` (only those
the query uses); a relationship owns ``r__src``, ``r__dst``, ``r__kind`` and its
properties; a path owns ``p__ids`` and ``p__len``; other values own ``v__v``.

Pattern predicates and subqueries become semi, anti or outer joins on the nodes
they share with the outer query; they are never evaluated row by row.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count, takewhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import scalars
from graphloom.operators import traverse
from graphloom.plans import syntax as s
from graphloom.plans.lexer import QueryError
from graphloom.plans.parser import parse
from graphloom.sources.graph import Graph

AGGREGATES = {"count", "collect", "sum", "avg", "min", "max", "stdev", "stdevp", "group_concat"}
_SQL_DISTINCT = {"avg": "avg", "stdev": "stddev", "stdevp": "stddev_pop"}  # those without a function of their own
_OWN = {"node": ("nid", "id", "kind"), "rel": ("src", "dst", "kind", "src_id", "dst_id")}


@dataclass(frozen=True)
class Bound:
    """What a variable is. kinds: of nodes or relationships; hops: of a path, if fixed."""

    what: str  # node, rel, path, value, lambda
    kinds: tuple[str, ...] = ()
    column: Column | None = None
    type: T.DataType | None = None


@dataclass(frozen=True)
class State:
    df: DataFrame | None
    scope: dict[str, Bound] = field(default_factory=dict)
    anchors: tuple[str, ...] = ()  # columns that keep the rows of an outer query apart


def columns_of(df: DataFrame, var: str) -> list[str]:
    return [c for c in df.columns if c.startswith(var + "__")]


def run(graph: Graph, text: str, params: dict | None = None, *, cap: int | None = None) -> DataFrame:
    """The result of a query over a graph. cap: rows a level of variable-length walks (None: all)."""
    return Planner(graph, {k.lower(): v for k, v in (params or {}).items()}, cap).query(parse(text))


class Planner:
    def __init__(self, graph: Graph, params: dict, cap: int | None = None):
        self.graph, self.params, self.cap, self.fresh = graph, params, cap, count()
        self.needs: dict[str, set[str]] = defaultdict(set)

    def name(self, stem: str = "x") -> str:
        return f"_{stem}{next(self.fresh)}"

    # which properties a variable must bring along

    def survey(self, q: s.Query) -> None:
        links: list[tuple[str, str]] = []
        quiet = set()
        for x in s.walk(q):
            if isinstance(x, s.Prop) and isinstance(x.of, s.Var):
                self.needs[x.of.name].add(x.name)
                quiet.add(id(x.of))
            elif isinstance(x, s.Projection):
                self.needs[x.var] |= {k for k, e in x.items if e is None}
            elif isinstance(x, (s.IsNull, s.HasLabel)) and isinstance(x.of, s.Var):
                quiet.add(id(x.of))
            elif isinstance(x, s.Call):
                if x.name in ("count", "id", "elementid", "labels", "type", "exists", "length", "nodes", "relationships", "startnode", "endnode"):
                    quiet |= {id(a) for a in x.args if isinstance(a, s.Var)}
                for a in x.args:
                    if isinstance(a, s.Var) and x.name in ("id", "elementid"):
                        self.needs[a.name].add("id")
                    elif isinstance(a, s.Var) and x.name in ("relationships", "rels"):
                        self.needs[a.name].add("#rels")
            elif isinstance(x, s.Item) and isinstance(x.expr, s.Var):
                links.append((x.expr.name, x.name))
                last_return = any(isinstance(c, s.Project) and c.final and x in c.items for arm in q.arms for c in arm)
                if not last_return:
                    quiet.add(id(x.expr))
        for x in s.walk(q):
            if isinstance(x, s.Binary) and x.op in ("=", "<>", "IN"):
                quiet |= {id(a) for a in (x.a, x.b) if isinstance(a, s.Var)}
        for x in s.walk(q):
            if isinstance(x, s.Var) and id(x) not in quiet:
                self.needs[x.name].add("*")
        for _ in range(len(links) + 1):
            for a, b in links:
                self.needs[a] |= self.needs[b]

    # queries

    def query(self, q: s.Query, start: State | None = None, top: bool = True) -> DataFrame:
        if top:
            self.survey(q)
        out = None
        for i, arm in enumerate(q.arms):
            df = self.arm(arm, start or State(None)).df
            if out is None:
                out = df
            else:
                if len(out.columns) != len(df.columns):
                    raise QueryError("arms of UNION differ in their number of columns")
                df = df.toDF(*out.columns)
                out = out.union(df)
                if not q.all[i - 1]:
                    out = out.distinct()
        return out

    def arm(self, clauses: tuple, state: State) -> State:
        passed = 0
        for i, c in enumerate(clauses):
            if i < passed:
                continue
            if isinstance(c, s.Match) and c.optional:
                run = tuple(takewhile(lambda x: isinstance(x, s.Match) and x.optional, clauses[i:]))
                passed = i + len(run)
                state = self.optionals(run, clauses[passed] if passed < len(clauses) else None, state)
            elif isinstance(c, s.Match):
                state = self.match(c, state)
            elif isinstance(c, s.Unwind):
                state = self.unwind(c, state)
            elif isinstance(c, s.CallQuery):
                state = self.call(c, state)
            else:
                state = self.project(c, state)
        return state

    def one_row(self, state: State) -> State:
        return state if state.df is not None else replace(state, df=self.graph.spark.range(1).select(F.lit(1).alias("_one")))

    def unwind(self, c: s.Unwind, state: State) -> State:
        state = self.one_row(state)
        state, (e,) = self.lifted(state, [c.source])
        col, t = self.expr(e, state)
        if not scalars.is_list(t):
            raise QueryError("UNWIND takes a list")
        df = state.df.withColumn(f"{c.var}__v", F.explode(col))
        return replace(state, df=df, scope=state.scope | {c.var: Bound("value", type=t.elementType)})

    def call(self, c: s.CallQuery, state: State) -> State:
        state = self.one_row(state)
        outer = [v for v in state.scope if any(isinstance(x, (s.Var, s.NodePattern, s.RelPattern)) and (getattr(x, "name", None) == v or getattr(x, "var", None) == v) for x in s.walk(c.query))]
        keys, inner = self.anchored(state, outer)
        df = self.query(c.query, inner, top=False) if outer else self.query(c.query, None, top=False)
        names = [n for n in df.columns if n not in inner.anchors]
        grouped = all(any(isinstance(x, s.Call) and x.name in AGGREGATES for i in arm[-1].items for x in s.walk(i)) and not any(not any(isinstance(x, s.Call) and x.name in AGGREGATES for x in s.walk(i)) for i in arm[-1].items) for arm in c.query.arms)
        df = df.select(*[F.col(f"`{a}`") for a in inner.anchors], *[F.col(f"`{n}`").alias(f"{n}__v") for n in names]) if outer else df.select(*[F.col(f"`{n}`").alias(f"{n}__v") for n in names])
        joined = self.back(state.df, keys, df, "left" if grouped and outer else "inner") if outer else state.df.crossJoin(df)
        if grouped and outer:
            for arm in c.query.arms:
                for i in arm[-1].items:
                    if isinstance(i.expr, s.Call) and i.expr.name == "count":
                        joined = joined.withColumn(f"{i.name}__v", F.coalesce(f"{i.name}__v", F.lit(0).cast("long")))
        return State(joined, state.scope | {n: Bound("value", type=df.schema[f"{n}__v"].dataType) for n in names}, state.anchors)

    # anchors: the outer rows that a correlated part starts from

    def anchored(self, state: State, names: list[str]) -> tuple[list[tuple[str, str]], State]:
        """Key columns with their names in the inner frame, and the inner state of distinct outer values."""
        keys = []
        cols, scope = [], {}
        for v in names:
            b = state.scope[v]
            own = columns_of(state.df, v)
            cols += own
            scope[v] = b
            key = [f"{v}__nid"] if b.what == "node" else [f"{v}__src", f"{v}__dst", f"{v}__kind"] if b.what == "rel" else [f"{v}__ids"] if b.what == "path" else own
            keys += [(k, self.name("a")) for k in key]
        inner = state.df.select(*cols).distinct().select(*cols, *[F.col(a).alias(b) for a, b in keys]) if cols else None
        return keys, State(inner, scope, tuple(b for _, b in keys))

    def back(self, df: DataFrame, keys: list[tuple[str, str]], inner: DataFrame, how: str) -> DataFrame:
        on = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) if not a.endswith("__nid") else F.col(a) == F.col(b) for a, b in keys])
        out = df.join(inner, on, how)
        return out if how in ("left_semi", "left_anti") else out.drop(*[b for _, b in keys])

    # MATCH

    def variables(self, *xs) -> set[str]:
        out = set()
        for x in s.walk(xs):
            if isinstance(x, s.Var):
                out.add(x.name)
            elif isinstance(x, (s.NodePattern, s.RelPattern)) and x.var:
                out.add(x.var)
        return out

    def match(self, c: s.Match, state: State) -> State:
        for p in c.patterns:
            state = self.pattern(p, state)
        return self.where(c.where, state) if c.where is not None else state

    def optionals(self, run: tuple[s.Match, ...], after, state: State) -> State:
        """Optional matches that follow each other, and the clause after them.

        Where that clause doesn't tell repeated rows apart and uses a match only
        behind others in a coalesce, it is matched after those, and only where they
        are null: otherwise the matches of a node would multiply.
        """
        used = [self.named(c) | {p.path for p in c.patterns if p.path} for c in run]
        first: list[tuple[s.Expr, ...]] = [()] * len(run)
        if len(run) > 1 and self.like_set(after):
            for i, u in enumerate(used):
                own = u - set(state.scope)
                if own < u and not any(own & x for j, x in enumerate(used) if j != i):
                    first[i] = self.before(own, after)
        left = list(range(len(run)))
        while left:
            ready = [i for i in left if self.named(first[i]) <= set(state.scope)]
            i = ready[0] if ready else left[0]
            left.remove(i)
            state = self.optional(run[i], state, first[i] if ready else ())
        return state

    def named(self, *xs) -> set[str]:
        return self.variables(xs) | {x.var for x in s.walk(xs) if isinstance(x, s.Projection)}

    def like_set(self, c) -> bool:
        """Whether repeated rows leave the result of a clause as it is."""
        if not isinstance(c, s.Project) or c.star:
            return False
        parts = list(s.walk((c.items, c.order)))
        if any(isinstance(x, (s.PatternExpr, s.PatternList, s.Subquery)) or isinstance(x, s.Call) and x.name == "rand" for x in parts):
            return False
        calls = [x for x in parts if self.is_aggregate(x)]
        return all(x.distinct or x.name in ("min", "max") for x in calls) if calls else c.distinct

    def before(self, own: set[str], c: s.Project) -> tuple[s.Expr, ...]:
        """The properties that stand before own variables in coalesce, if a clause uses these nowhere else and always behind the same ones."""
        found = set()

        def look(x) -> None:
            if not self.named(x) & own:
                return
            if isinstance(x, s.Call) and x.name == "coalesce" and not any(self.is_aggregate(y) for y in s.walk(x)):
                head = tuple(takewhile(lambda a: isinstance(a, s.Prop) and isinstance(a.of, s.Var) and a.of.name not in own, x.args))
                found.add(head)
            elif isinstance(x, (s.Var, s.Projection, s.Comprehension, s.Quantifier, s.Reduce)):
                found.add(())
            else:
                for y in x if isinstance(x, tuple) else x.__dict__.values():
                    look(y)

        look((c.items, c.order))
        return found.pop() if len(found) == 1 else ()

    def optional(self, c: s.Match, state: State, first: tuple[s.Expr, ...] = ()) -> State:
        """first: rows where any of these is not null stay without a match."""
        if state.df is None:
            state = self.one_row(state)
        used = [v for v in state.scope if v in self.variables(c.patterns, c.where)]
        if not used:
            inner = self.match(c, State(None))
            new = {v: b for v, b in inner.scope.items()}
            return State(state.df.join(inner.df, F.lit(True), "left"), state.scope | new, state.anchors)
        if len(used) == 1 and state.scope[used[0]].what == "node" and all(r.hops is None for p in c.patterns for r in p.rels):
            # from all nodes of these kinds: cheaper than the distinct rows so far
            v, b = used[0], state.scope[used[0]]
            key = self.name("a")
            scan = self.scan(v, list(b.kinds) or list(self.graph.nodes))
            keys, inner = [(f"{v}__nid", key)], State(scan.withColumn(key, F.col(f"{v}__nid")), {v: b}, (key,))
        else:
            keys, inner = self.anchored(state, used)
        inner = self.match(c, inner)
        new = {v: b for v, b in inner.scope.items() if v not in state.scope}
        cols = [x for v in new for x in columns_of(inner.df, v)]
        if not first:
            df = self.back(state.df, keys, inner.df.select(*[b for _, b in keys], *cols), "left")
            return State(df, state.scope | new, state.anchors)
        # a key of 0 on the inner side, which must not look constant; rows that need no match are spread over other keys
        here, there, taken = self.name("f"), self.name("f"), [self.expr(e, state)[0] for e in first]
        free = reduce(lambda a, b: a & b, [x.isNull() for x in taken])
        outer = state.df.withColumn(here, F.when(free, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*[x.cast("string") for x in taken]), F.lit(1 << 40)) + 1))
        inner_df = inner.df.withColumn(there, F.pmod(F.xxhash64(*[b for _, b in keys]), F.lit(1).cast("long")))
        keys = [*keys, (here, there)]
        df = self.back(outer, keys, inner_df.select(*[b for _, b in keys], *cols), "left").drop(here)
        return State(df, state.scope | new, state.anchors)

    def scan(self, var: str, kinds: list[str], more: tuple[str, ...] = ()) -> DataFrame:
        wanted = self.needs[var] | set(more)
        props = self.graph.node_props(kinds)
        own_kind = ["own_kind"] if "own_kind" in props and "kind" in wanted else []
        props = props if "*" in wanted else [p for p in props if p in wanted and p != "own_kind"] + own_kind
        df = self.graph.scan(kinds, props)
        return df.select(*[F.col(k).alias(f"{var}__{k}") for k in ("nid", "id", "kind")], *[F.col(p).alias(f"{var}__p_{p}") for p in props])

    def pattern(self, p: s.Pattern, state: State) -> State:
        nodes = [replace(n, var=n.var or self.name("n")) for n in p.nodes]
        rels = [replace(r, var=r.var or self.name("r")) for r in p.rels]
        start = next((i for i, n in enumerate(nodes) if n.var in state.scope), None)
        if start is None:
            start = next((i for i, n in enumerate(nodes) if n.props), 0)
            state = self.fresh_node(nodes[start], state)
        else:
            state = self.check_node(nodes[start], state)
        for i in range(start, len(rels)):
            state = self.hop(rels[i], nodes[i], nodes[i + 1], state, p)
        for i in range(start - 1, -1, -1):
            flip = {"out": "in", "in": "out", "both": "both"}[rels[i].direction]
            state = self.hop(replace(rels[i], direction=flip), nodes[i + 1], nodes[i], state, p)
        if p.path:
            state = self.bind_path(p.path, nodes, rels, start, state)
        elif p.path is None:
            pass
        return state

    def bind_path(self, path: str, nodes, rels, start: int, state: State) -> State:
        ids, length = F.array(F.col(f"{nodes[0].var}__id")), F.lit(0)
        for i, (r, n) in enumerate(zip(rels, nodes[1:], strict=True)):
            if r.hops is None:
                ids, length = F.concat(ids, F.array(F.col(f"{n.var}__id"))), length + 1
            else:
                part = F.col(f"{r.var}__ids")
                part = F.reverse(part) if i < start else part
                ids, length = F.concat(ids, F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0)))), length + F.col(f"{r.var}__len")
        df = state.df.withColumn(f"{path}__ids", ids).withColumn(f"{path}__len", length.cast("long"))
        if all(r.hops is None for r in rels):
            df = df.withColumn(f"{path}__rels", F.array(*[self.rel_value(r.var, df) for r in rels]))
        elif "#rels" in self.needs[path]:
            steps = []
            for i, r in enumerate(rels):
                part = F.col(f"{r.var}__via") if r.hops is not None else F.array(F.struct(F.col(f"{r.var}__kind").alias("type"), F.col(f"{r.var}__src").alias("from"), F.col(f"{r.var}__dst").alias("to")))
                steps.append(F.reverse(part) if i < start and r.hops is not None else part)
            df = df.withColumn(f"{path}__rels", F.concat(*steps))
        return replace(state, df=df, scope=state.scope | {path: Bound("path")})

    def fresh_node(self, n: s.NodePattern, state: State) -> State:
        kinds = self.graph.kinds(n.labels)
        scan = self.scan(n.var, kinds, tuple(k for k, _ in n.props))
        df = scan if state.df is None else state.df.crossJoin(scan)
        return self.node_props(n, State(df, state.scope | {n.var: Bound("node", tuple(kinds))}, state.anchors))

    def check_node(self, n: s.NodePattern, state: State) -> State:
        if state.scope[n.var].what != "node":
            raise QueryError(f"{n.var} is no node")
        if n.labels:
            kinds = self.graph.kinds(n.labels)
            if not set(state.scope[n.var].kinds) <= set(kinds) or not state.scope[n.var].kinds:
                state = replace(state, df=state.df.where(F.col(f"{n.var}__kind").isin(kinds)))
                both = tuple(k for k in state.scope[n.var].kinds if k in kinds)
                state = replace(state, scope=state.scope | {n.var: Bound("node", both or tuple(kinds))})
        return self.node_props(n, state)

    def node_props(self, n: s.NodePattern, state: State) -> State:
        for k, e in n.props:
            state = self.where(s.Binary("=", s.Prop(s.Var(n.var), k), e), state)
        return state

    def hop(self, r: s.RelPattern, a: s.NodePattern, b: s.NodePattern, state: State, p: s.Pattern) -> State:
        kinds = self.graph.rel_kinds(r.types)
        if r.hops is not None or p.shortest:
            return self.walk(replace(r, hops=r.hops or (1, 1)), a, b, state, p, kinds)
        wanted = self.needs[r.var] | {k for k, _ in r.props}
        props = self.graph.rel_props(kinds)
        props = props if "*" in wanted else [x for x in props if x in wanted]
        edges = self.graph.links(kinds, props)
        edges = edges.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("src").alias(f"{r.var}__src"), F.col("dst").alias(f"{r.var}__dst"), F.col("kind").alias(f"{r.var}__kind"), *[F.col(x).alias(f"{r.var}__p_{x}") for x in props])
        if r.direction != "out":
            turned = edges.select(F.col("d").alias("s"), F.col("s").alias("d"), *edges.columns[2:])
            edges = turned if r.direction == "in" else edges.unionByName(turned.where("s <> d"))
        near, far = self.name("s"), self.name("d")
        edges = edges.withColumnsRenamed({"s": near, "d": far})
        bound = state.scope | {r.var: Bound("rel", tuple(kinds))}
        on = F.col(f"{a.var}__nid") == F.col(near)
        if r.var in state.scope:
            raise QueryError(f"{r.var} is bound already")
        if b.var in state.scope:
            df = state.df.join(edges, on & (F.col(f"{b.var}__nid") == F.col(far))).drop(near, far)
            state = self.check_node(b, State(df, bound, state.anchors))
        else:
            df = state.df.join(edges, on).drop(near)
            state = self.arrive(b, far, State(df, bound, state.anchors), self.far_kinds(kinds, r.direction))
        for k, e in r.props:
            state = self.where(s.Binary("=", s.Prop(s.Var(r.var), k), e), state)
        return state

    def far_kinds(self, kinds: list[str], direction: str) -> list[str] | None:
        """Node kinds at the far end, where the tables of the relationships fix them."""
        ends = set()
        for k in kinds:
            e = self.graph.edges[k]
            ends |= (e.kinds(True) if direction != "out" else set()) | (e.kinds(False) if direction != "in" else set())
        return None if None in ends else [k for k in self.graph.nodes if k in ends]

    def arrive(self, n: s.NodePattern, at: str, state: State, possible: list[str] | None) -> State:
        kinds = self.graph.kinds(n.labels)
        if possible is not None:
            kinds = [k for k in kinds if k in possible]
        scan = self.scan(n.var, kinds, tuple(k for k, _ in n.props))
        df = state.df.join(scan, F.col(at) == F.col(f"{n.var}__nid")).drop(at)
        return self.node_props(n, State(df, state.scope | {n.var: Bound("node", tuple(kinds))}, state.anchors))

    def walk(self, r: s.RelPattern, a: s.NodePattern, b: s.NodePattern, state: State, p: s.Pattern, kinds: list[str]) -> State:
        wanted = [k for k, _ in r.props]
        edges = self.graph.links(kinds, wanted)
        for k, e in r.props:
            col, _ = self.expr(e, State(edges, {}))
            edges = edges.where(F.col(k) == col)
        start, end = self.name("s"), self.name("e")
        seeds = state.df.select(F.col(f"{a.var}__nid").alias("start")).where("start is not null").distinct()
        with_rels = bool(p.path) and "#rels" in self.needs[p.path]
        if with_rels:
            edges = edges.select("src", "dst", F.struct(F.col("kind").alias("type"), F.col("src").alias("from"), F.col("dst").alias("to")).alias("via"))
        paths = traverse.simple_paths(seeds, edges, r.hops[0], r.hops[1], r.direction, shortest=bool(p.shortest), cap=self.cap, via="via" if with_rels else None)
        names = {"start": start, "end": end, "depth": f"{r.var}__len", "path": f"{r.var}__nids"} | ({"via": f"{r.var}__via"} if with_rels else {})
        if p.path or "*" in self.needs[r.var]:
            # ids along the path, in order
            own = paths.columns
            path = paths.select(*own, F.posexplode("path").alias("i", "nid"))
            ids = self.graph.scan(list(self.graph.nodes), []).select("nid", "id")
            paths = path.join(ids, "nid").groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("i", "id"))).alias("x")).select(*own, F.col("x.id").alias("ids"))
            names["ids"] = f"{r.var}__ids"
        paths = paths.select(*[F.col(k).alias(v) for k, v in names.items()])
        df = state.df.join(paths, F.col(f"{a.var}__nid") == F.col(start)).drop(start)
        scope = state.scope | {r.var: Bound("path")}
        if b.var in state.scope:
            df = df.where(F.col(f"{b.var}__nid") == F.col(end)).drop(end)
            return self.check_node(b, State(df, scope, state.anchors))
        return self.arrive(b, end, State(df, scope, state.anchors), None if r.hops[0] == 0 else self.far_kinds(kinds, r.direction))

    # WHERE

    def where(self, e: s.Expr, state: State) -> State:
        if isinstance(e, s.Binary) and e.op == "AND":
            return self.where(e.b, self.where(e.a, state))
        negated, inner = False, e
        while isinstance(inner, s.Unary) and inner.op == "NOT":
            negated, inner = not negated, inner.of
        if isinstance(inner, s.PatternExpr) or isinstance(inner, s.Subquery) and inner.kind == "exists":
            state = self.one_row(state)
            query = s.Query(((s.Match((inner.pattern,), None, False),),)) if isinstance(inner, s.PatternExpr) else inner.query
            keys, found = self.matches(query, state)
            return replace(state, df=self.back(state.df, keys, found.df.select(*[b for _, b in keys]).distinct(), "left_anti" if negated else "left_semi"))
        state, (e,) = self.lifted(state, [e])
        return replace(state, df=state.df.where(self.expr(e, state)[0]))

    def matches(self, query: s.Query, state: State) -> tuple[list[tuple[str, str]], State]:
        """Rows of a correlated query, by the outer variables it uses."""
        used = [v for v in state.scope if state.scope[v].what != "lambda" and v in self.variables(query)]
        if not used:
            raise QueryError("a subquery must share a variable with the query around it")
        arms = []
        keys = None
        for arm in query.arms:
            k, inner = self.anchored(state, used)
            keys = keys or k
            got = self.arm(arm if self.rows_matter(query, arm) else tuple(c for c in arm if not (isinstance(c, s.Project) and c.final)), replace(inner))
            for old, new in zip(inner.anchors, [b for _, b in keys], strict=True):
                got = replace(got, df=got.df.withColumnRenamed(old, new)) if old != new else got
            arms.append(got)
        if len(arms) == 1:
            return keys, replace(arms[0], anchors=tuple(b for _, b in keys))
        names = [b for _, b in keys]
        out = None
        for i, a in enumerate(arms):
            # arms are put together by the places of their columns
            df = a.df.select(*names, *[F.col(f"`{c}`") for c in a.df.columns if c not in names]) if self.rows_matter(query, query.arms[i]) else a.df.select(*names)
            if out is None:
                out = df
            elif len(out.columns) != len(df.columns):
                raise QueryError("arms of UNION differ in their number of columns")
            else:
                out = out.union(df.toDF(*out.columns)) if query.all[i - 1] else out.union(df.toDF(*out.columns)).distinct()
        return keys, State(out, {}, tuple(names))

    def rows_matter(self, query: s.Query, arm: tuple) -> bool:
        """Whether what an arm returns decides how many rows it has: DISTINCT, SKIP, LIMIT, aggregates, a UNION that drops repeats."""
        if not all(query.all):
            return True
        last = arm[-1]
        return isinstance(last, s.Project) and last.final and (last.distinct or last.skip is not None or last.limit is not None or any(self.is_aggregate(x) for i in last.items for x in s.walk(i)))

    # subqueries inside expressions become columns

    def lifted(self, state: State, exprs: list[s.Expr]) -> tuple[State, list[s.Expr]]:
        if not any(isinstance(x, (s.PatternExpr, s.PatternList, s.Subquery)) or self.is_end(x, state) for x in s.walk(tuple(exprs))):
            return state, exprs
        state = self.one_row(state)
        box = [state]

        def fix(x):
            if isinstance(x, (s.PatternExpr, s.PatternList, s.Subquery)):
                return self.as_column(x, box)
            if self.is_end(x, state):
                return self.end_property(x, box)
            if isinstance(x, tuple):
                return tuple(fix(y) for y in x)
            if isinstance(x, s.Expr):
                return replace(x, **{k: fix(v) for k, v in x.__dict__.items()})
            return x

        out = [fix(e) for e in exprs]
        return box[0], out

    @staticmethod
    def is_end(x, state: State) -> bool:
        """A property of startNode(r) or endNode(r)."""
        if not (isinstance(x, s.Prop) and isinstance(x.of, s.Call) and x.of.name in ("startnode", "endnode") and x.of.args):
            return False
        r = x.of.args[0]
        return isinstance(r, s.Var) and r.name in state.scope and state.scope[r.name].what == "rel"

    def end_property(self, x: s.Prop, box: list[State]) -> s.Expr:
        state, name, v = box[0], self.name("q"), x.of.args[0].name
        first = x.of.name == "startnode"
        ends = set().union(*(self.graph.edges[k].kinds(first) for k in state.scope[v].kinds))
        kinds = [k for k in self.graph.nodes if None in ends or k in ends]
        own = x.name in self.graph.node_props(kinds)
        scan = self.graph.scan(kinds, [x.name] if own else [])
        col = F.col(x.name) if own or x.name in ("id", "kind") else F.lit(None).cast("string")
        scan = scan.select(F.col("nid").alias(name), col.alias(f"{name}__v"))
        df = state.df.join(scan, F.col(f"{v}__{'src' if first else 'dst'}") == F.col(name), "left").drop(name)
        box[0] = replace(state, df=df, scope=state.scope | {name: Bound("value", type=scan.schema[f"{name}__v"].dataType)})
        return s.Var(name)

    def as_column(self, x: s.Expr, box: list[State]) -> s.Expr:
        state, name = box[0], self.name("q")
        if isinstance(x, s.PatternList):
            query = s.Query(((s.Match((x.pattern,), x.where, False),),))
            keys, found = self.matches(query, state)
            found, (e,) = self.lifted(found, [x.result])
            col, t = self.value(e, found)
            got = found.df.groupBy(*[b for _, b in keys]).agg(F.collect_list(col).alias(f"{name}__v"))
            kind = T.ArrayType(t or found.df.select(col.alias("x")).schema["x"].dataType)
            empty = F.array().cast(kind)
        else:
            exists = not (isinstance(x, s.Subquery) and x.kind == "count")
            query = x.query if isinstance(x, s.Subquery) else s.Query(((s.Match((x.pattern,), None, False),),))
            keys, found = self.matches(query, state)
            got = found.df.groupBy(*[b for _, b in keys]).agg((F.lit(True) if exists else F.count("*")).alias(f"{name}__v"))
            kind, empty = (T.BooleanType(), F.lit(False)) if exists else (T.LongType(), F.lit(0).cast("long"))
        df = self.back(state.df, keys, got, "left").withColumn(f"{name}__v", F.coalesce(f"{name}__v", empty))
        box[0] = replace(state, df=df, scope=state.scope | {name: Bound("value", type=kind)})
        return s.Var(name)

    # WITH and RETURN

    def project(self, c: s.Project, state: State) -> State:
        state = self.one_row(state)
        items = list(c.items)
        if c.star:
            items = [s.Item(s.Var(v), v) for v in state.scope if not v.startswith("_")] + items
        state, exprs = self.lifted(state, [i.expr for i in items])
        items = [s.Item(e, i.name) for e, i in zip(exprs, items, strict=True)]
        aggregated = any(self.is_aggregate(x) for i in items for x in s.walk(i.expr))
        order = list(c.order)
        if aggregated:
            state, items, order = self.aggregate(items, order, state)
        df, scope, renamed = state.df, {}, {}
        outputs: list[Column] = []
        for i in items:
            b = state.scope.get(i.expr.name) if isinstance(i.expr, s.Var) else None
            temp = self.name("o")
            if b and b.what in ("node", "rel", "path"):
                for col in columns_of(df, i.expr.name):
                    outputs.append(F.col(col).alias(temp + "__" + col.split("__", 1)[1]))
                scope[i.name] = b
            else:
                col, t = self.value(i.expr, state)
                outputs.append(col.alias(f"{temp}__v"))
                scope[i.name] = Bound("value", type=t)
            renamed[i.name] = temp
        if order and not (aggregated or c.distinct):
            # sort keys may use what goes in as well as what comes out
            keep = df.columns
            df = df.select(*keep, *outputs)
        else:
            keep = []
            df = df.select(*outputs, *[F.col(a) for a in state.anchors])
            if c.distinct:
                df = df.distinct()
        shown = {n: replace(b, type=b.type or (df.schema[f"{renamed[n]}__v"].dataType if b.what == "value" else None)) for n, b in scope.items()}
        if order:
            texts = {i.expr: i.name for i in items}
            alias = {renamed[n]: b for n, b in shown.items()} | ({v: b for v, b in state.scope.items()} if keep else {})
            swap = {n: s.Var(renamed[n]) for n in shown}
            by = []
            # a name given to a value here still means the node where a property of it is asked for
            swap |= {x: x for e, _ in order for x in s.walk(e) if keep and isinstance(x, s.Prop) and isinstance(x.of, s.Var) and x.of.name in shown and shown[x.of.name].what == "value" and x.of.name in state.scope and state.scope[x.of.name].what != "value"}
            for e, up in order:
                e = s.Var(texts[e]) if e in texts else e
                col = self.value(self.substitute(e, swap), State(df, alias, state.anchors))[0]
                by.append(col.asc() if up else col.desc())
            df = df if state.anchors else df.orderBy(*by)
        if state.anchors and (c.skip is not None or c.limit is not None):
            # rows of an outer row count by themselves; without an order by what they hold
            lo, hi = self.number(c.skip, 0), self.number(c.limit, None)
            by = by if order else [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, T.AtomicType)] or [F.lit(0)]
            df = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*state.anchors).orderBy(*by)))
            df = df.where((F.col("_rank") > lo) & (F.col("_rank") <= lo + hi if hi is not None else F.lit(True))).drop("_rank")
        elif not state.anchors:
            if c.skip is not None:
                df = df.offset(self.number(c.skip, 0))
            if c.limit is not None:
                df = df.limit(self.number(c.limit, 0))
        final = []
        for n, b in shown.items():
            if c.final:
                final.append(self.result(renamed[n], b, df).alias(n))
            else:
                final += [F.col(col).alias(n + "__" + col.split("__", 1)[1]) for col in columns_of(df, renamed[n])]
        df = df.select(*final, *[F.col(a) for a in state.anchors])
        out = State(df, shown, state.anchors)
        return self.where(c.where, out) if c.where is not None else out

    def result(self, stem: str, b: Bound, df: DataFrame) -> Column:
        if b.what == "node":
            return self.node_value(stem, df)
        if b.what == "rel":
            return self.rel_value(stem, df)
        return F.col(f"{stem}__ids") if b.what == "path" else F.col(f"{stem}__v")

    def number(self, e: s.Expr | None, default):
        if e is None:
            return default
        v = e.value if isinstance(e, s.Lit) else self.params.get(e.name.lower()) if isinstance(e, s.Param) else None
        if v is None or isinstance(v, bool) or int(v) < 0:
            raise QueryError("SKIP and LIMIT take a number or a parameter")
        return int(v)

    @staticmethod
    def is_aggregate(x) -> bool:
        return isinstance(x, s.Call) and x.name in AGGREGATES

    def substitute(self, e, swap: dict):
        """e with variables and whole expressions replaced."""
        if isinstance(e, s.Expr) and e in swap:
            return swap[e]
        if isinstance(e, s.Var):
            return swap.get(e.name, e)
        if isinstance(e, tuple):
            return tuple(self.substitute(x, swap) for x in e)
        if isinstance(e, s.Expr):
            return replace(e, **{k: self.substitute(v, swap) for k, v in e.__dict__.items()})
        return e

    def aggregate(self, items: list[s.Item], order: list, state: State) -> tuple[State, list[s.Item], list]:
        """Groups by the items without aggregates; what is left of the others refers to one column per aggregate."""
        exprs = [i.expr for i in items] + [e for e, _ in order]
        calls = list(dict.fromkeys(x for e in exprs for x in s.walk(e) if self.is_aggregate(x)))
        keys = [i for i in items if not any(self.is_aggregate(x) for x in s.walk(i.expr))]
        group, scope, swap = [F.col(a) for a in state.anchors], {}, {}
        for i in keys:
            b = state.scope.get(i.expr.name) if isinstance(i.expr, s.Var) else None
            name = self.name("k")
            if b and b.what in ("node", "rel", "path"):
                group += [F.col(c).alias(name + "__" + c.split("__", 1)[1]) for c in columns_of(state.df, i.expr.name)]
                scope[name] = b
            else:
                col, t = self.value(i.expr, state)
                group.append(col.alias(f"{name}__v"))
                scope[name] = Bound("value", type=t)
            swap[i.expr] = s.Var(name)
        aggs = []
        for x in calls:
            name = self.name("g")
            if x.distinct and x.name in _SQL_DISTINCT:
                own = self.name("d")
                state = replace(state, df=state.df.withColumn(own, self.value(x.args[0], state)[0]))
                col, t = F.expr(f"{_SQL_DISTINCT[x.name]}(DISTINCT {own})"), T.DoubleType()
            else:
                col, t = self.aggregate_call(x, state)
            aggs.append(col.alias(f"{name}__v"))
            scope[name] = Bound("value", type=t)
            swap[x] = s.Var(name)
        df = state.df.groupBy(*group).agg(*aggs) if aggs else state.df.select(*group).distinct()
        scope = {n: replace(b, type=b.type or df.schema[f"{n}__v"].dataType) if b.what == "value" else b for n, b in scope.items()}
        new = [s.Item(self.substitute(i.expr, swap), i.name) for i in items]
        return State(df, scope, state.anchors), new, [(self.substitute(e, swap), up) for e, up in order]

    def aggregate_call(self, x: s.Call, state: State) -> tuple[Column, T.DataType | None]:
        if x.star:
            return F.count("*"), T.LongType()
        (arg,) = x.args
        b = state.scope.get(arg.name) if isinstance(arg, s.Var) else None
        if x.name == "count" and b and b.what in ("node", "rel"):
            cols = [F.col(f"{arg.name}__nid")] if b.what == "node" else [F.col(f"{arg.name}__src"), F.col(f"{arg.name}__dst"), F.col(f"{arg.name}__kind")]
            return (F.count_distinct(*cols) if x.distinct else F.count(cols[0])), T.LongType()
        col, t = self.value(arg, state)
        if x.name == "group_concat":
            return F.array_join(F.array_sort((F.collect_set if x.distinct else F.collect_list)(col.cast("string"))), ","), T.StringType()
        if x.name == "count":
            return (F.count_distinct(col) if x.distinct else F.count(col)), T.LongType()
        if x.name == "collect":
            return (F.collect_set(col) if x.distinct else F.collect_list(col)), T.ArrayType(t) if t else None
        f = {"sum": F.sum_distinct if x.distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stdev": F.stddev, "stdevp": F.stddev_pop}[x.name]
        return f(col), None

    # expressions

    def node_value(self, v: str, df: DataFrame) -> Column:
        props = [c for c in columns_of(df, v) if c.startswith(f"{v}__p_")]
        inner = F.struct(*[F.col(c).alias(c[len(v) + 4 :]) for c in props]) if props else F.struct(F.lit(None).alias("none"))
        return F.when(F.col(f"{v}__nid").isNotNull(), F.struct(F.col(f"{v}__id").alias("id"), F.col(f"{v}__kind").alias("kind"), inner.alias("properties")))

    def rel_value(self, v: str, df: DataFrame) -> Column:
        props = [c for c in columns_of(df, v) if c.startswith(f"{v}__p_")]
        inner = F.struct(*[F.col(c).alias(c[len(v) + 4 :]) for c in props]) if props else F.struct(F.lit(None).alias("none"))
        return F.when(F.col(f"{v}__src").isNotNull(), F.struct(F.col(f"{v}__kind").alias("type"), F.col(f"{v}__src").alias("from"), F.col(f"{v}__dst").alias("to"), inner.alias("properties")))

    def value(self, e: s.Expr, state: State) -> tuple[Column, T.DataType | None]:
        """An expression as a value: whole nodes and relationships become structs."""
        if isinstance(e, s.Var) and e.name in state.scope:
            b = state.scope[e.name]
            if b.what == "node":
                return self.node_value(e.name, state.df), None
            if b.what == "rel":
                return self.rel_value(e.name, state.df), None
        return self.expr(e, state)

    def typed(self, e: s.Expr, state: State) -> tuple[Column, T.DataType]:
        col, t = self.value(e, state)
        if t is None:
            try:
                t = state.df.select(col.alias("x")).schema["x"].dataType
            except Exception:  # noqa: BLE001  a lambda's variable has no type outside of it
                t = T.StringType()
        return col, t

    def expr(self, e: s.Expr, state: State) -> tuple[Column, T.DataType | None]:
        return getattr(self, "_" + type(e).__name__.lower())(e, state)

    def _lit(self, e, state):
        return scalars.literal(e.value)

    def _param(self, e, state):
        if e.name.lower() not in self.params:
            raise QueryError(f"parameter ${e.name} is missing")
        return scalars.literal(self.params[e.name.lower()])

    def _var(self, e, state):
        b = state.scope.get(e.name)
        if b is None:
            raise QueryError(f"unknown variable {e.name}")
        if b.what == "lambda":
            return b.column, b.type
        if b.what == "node":
            return F.col(f"{e.name}__nid"), T.LongType()
        if b.what == "rel":
            return F.struct(f"{e.name}__src", f"{e.name}__dst", f"{e.name}__kind"), None
        if b.what == "path":
            return F.col(f"{e.name}__ids"), T.ArrayType(T.StringType())
        return F.col(f"{e.name}__v"), b.type or state.df.schema[f"{e.name}__v"].dataType

    def _prop(self, e, state):
        if isinstance(e.of, s.Call) and e.of.name in ("startnode", "endnode"):
            raise QueryError("name the end nodes in the pattern to use their properties")
        b = state.scope.get(e.of.name) if isinstance(e.of, s.Var) else None
        if b and b.what in ("node", "rel"):
            v = e.of.name
            types = dict(state.df.dtypes)
            own = f"{v}__p_{e.name}"
            if own in types:
                return F.col(own), state.df.schema[own].dataType
            if e.name == "kind" and f"{v}__p_own_kind" in types:
                return F.coalesce(F.col(f"{v}__p_own_kind").cast("string"), F.col(f"{v}__kind")), T.StringType()
            if b.what == "rel":
                names = {"from": f"{v}__src", "to": f"{v}__dst", "kind": f"{v}__kind", "type": f"{v}__kind", "id": None}
                if e.name == "id":
                    return F.xxhash64(f"{v}__src", f"{v}__kind", f"{v}__dst"), T.LongType()
                if e.name in names:
                    return F.col(names[e.name]), state.df.schema[names[e.name]].dataType
            if e.name in ("id", "kind", "nid"):
                return F.col(f"{v}__{e.name}"), state.df.schema[f"{v}__{e.name}"].dataType
            if e.name == "properties":
                return F.to_json(self.node_value(v, state.df)["properties"]), T.StringType()
            return F.lit(None).cast("string"), scalars.Missing()
        col, t = self.typed(e.of, state)
        if isinstance(t, T.StructType):
            inner = t["properties"].dataType if "properties" in t.names else None
            if isinstance(inner, T.StructType) and e.name in inner.names:
                return col["properties"][e.name], inner[e.name].dataType
            return (col[e.name], t[e.name].dataType) if e.name in t.names else (F.lit(None).cast("string"), T.StringType())
        if isinstance(t, T.MapType):
            return F.try_element_at(col, F.lit(e.name)), t.valueType
        if isinstance(t, T.StringType):
            return (col, t) if e.name == "id" else (F.get_json_object(col, "$." + e.name), T.StringType())
        return F.lit(None).cast("string"), T.StringType()

    def _index(self, e, state):
        if isinstance(e.of, s.Call) and e.of.name == "labels" and isinstance(e.at, s.Lit) and e.at.value == 0:
            return F.col(f"{e.of.args[0].name}__kind"), T.StringType()
        if isinstance(e.at, s.Lit) and isinstance(e.at.value, str):
            return self._prop(s.Prop(e.of, e.at.value), state)
        col, t = self.typed(e.of, state)
        at, kind = self.typed(e.at, state)
        if scalars.is_list(t):
            return F.try_element_at(col, F.when(at >= 0, at + 1).otherwise(at).cast("int")), t.elementType
        return F.try_element_at(col, at), t.valueType if isinstance(t, T.MapType) else None

    def _slice(self, e, state):
        col, t = self.typed(e.of, state)
        n = F.size(col)
        at = lambda x, default: default if x is None else (lambda c: F.when(c < 0, F.greatest(n + c, F.lit(0))).otherwise(F.least(c, n)))(self.expr(x, state)[0].cast("int"))
        lo, hi = at(e.lo, F.lit(0)), at(e.hi, n)
        return F.slice(col, lo + 1, F.greatest(hi - lo, F.lit(0))), t

    def _haslabel(self, e, state):
        kinds = self.graph.kinds(e.labels)
        return F.col(f"{e.of.name}__kind").isin(kinds) if kinds else F.lit(False), T.BooleanType()

    def _unary(self, e, state):
        if e.op == "NOT":
            return ~self.boolean(e.of, state), T.BooleanType()
        col, t = self.typed(e.of, state)
        return -col, t

    def boolean(self, e, state) -> Column:
        col, t = self.typed(e, state)
        return col if isinstance(t, T.BooleanType) else col.cast("boolean")

    def _isnull(self, e, state):
        b = state.scope.get(e.of.name) if isinstance(e.of, s.Var) else None
        col = F.col(f"{e.of.name}__src") if b and b.what == "rel" else self.expr(e.of, state)[0]
        return (col.isNotNull() if e.negated else col.isNull()), T.BooleanType()

    def _binary(self, e, state):
        op = e.op
        if op in ("AND", "OR", "XOR"):
            a, b = self.boolean(e.a, state), self.boolean(e.b, state)
            return (a & b if op == "AND" else a | b if op == "OR" else (a & ~b) | (~a & b)), T.BooleanType()
        if op == "IN":
            return self.contains(e, state), T.BooleanType()
        nodes = [x for x in (e.a, e.b) if isinstance(x, s.Var) and x.name in state.scope and state.scope[x.name].what == "node"]
        if op in ("=", "<>") and len(nodes) == 2:
            a, b = (F.col(f"{x.name}__nid") for x in nodes)
            return (a == b if op == "=" else a != b), T.BooleanType()
        (a, ta), (b, tb) = self.typed(e.a, state), self.typed(e.b, state)
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return self.compare(op, a, ta, b, tb), T.BooleanType()
        if op in ("STARTS", "ENDS", "CONTAINS"):
            a, b = F.lower(a.cast("string")), F.lower(b.cast("string"))
            return {"STARTS": F.startswith, "ENDS": F.endswith, "CONTAINS": F.contains}[op](a, b), T.BooleanType()
        if op == "=~":
            if isinstance(e.b, s.Lit) and not e.b.value:
                return F.lit(False), T.BooleanType()
            return F.rlike(a.cast("string"), b), T.BooleanType()
        numbers = [isinstance(t, (T.NumericType, T.NullType)) for t in (ta, tb)]
        if op == "+" and (scalars.is_list(ta) or scalars.is_list(tb)):
            item = scalars.common([t.elementType if scalars.is_list(t) else t for t in (ta, tb)])
            whole = T.ArrayType(item)
            part = lambda c, t: (c if scalars.is_list(t) else F.array(c)).cast(whole)
            return F.concat(part(a, ta), part(b, tb)), whole
        if op == "+" and not all(numbers):
            return F.concat(a.cast("string"), b.cast("string")), T.StringType()
        whole = all(isinstance(t, T.IntegralType) for t in (ta, tb))
        if not all(numbers):
            a, b = (c if n else c.cast("string").try_cast("double") for c, n in zip((a, b), numbers, strict=True))
        kind = T.LongType() if whole else T.DoubleType()
        if op in ("+", "-", "*"):
            return (a + b if op == "+" else a - b if op == "-" else a * b), kind
        if op == "^":
            return F.pow(a.cast("double"), b.cast("double")), T.DoubleType()
        zero = F.nullif(b, F.lit(0).cast("long") if whole else F.lit(0.0))
        if op == "%":
            return F.try_mod(a, b), kind
        if whole:
            return F.call_function("div", a.cast("long"), zero.cast("long")), kind
        return F.try_divide(a.cast("double"), b.cast("double")), kind

    @staticmethod
    def compare(op: str, a: Column, ta, b: Column, tb) -> Column:
        if isinstance(ta, T.BooleanType) != isinstance(tb, T.BooleanType):
            a, b = a.cast("string"), b.cast("string")
        elif isinstance(ta, T.StringType) and isinstance(tb, T.NumericType):
            a = a.try_cast("double")
        elif isinstance(tb, T.StringType) and isinstance(ta, T.NumericType):
            b = b.try_cast("double")
        elif scalars.is_list(ta) or scalars.is_list(tb):
            a, b = (F.to_json(c) if scalars.is_list(t) else c.cast("string") for c, t in ((a, ta), (b, tb)))
        elif isinstance(tb, T.StringType) and isinstance(ta, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            b = b.try_cast(ta)
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def contains(self, e, state) -> Column:
        a, ta = self.value(e.a, state)
        b = state.scope.get(e.a.name) if isinstance(e.a, s.Var) else None
        if isinstance(e.b, s.ListLit):
            if not e.b.items:
                return F.lit(False)
            if all(isinstance(x, (s.Lit, s.Param)) for x in e.b.items):
                a, ta = self.typed(e.a, state)
                return reduce(lambda x, y: x | y, [self.compare("=", a, ta, *self.typed(x, state)) for x in e.b.items])
        items, t = self.typed(e.b, state)
        if b and b.what == "node":
            return F.array_contains(F.transform(items, lambda x: x["id"]), F.col(f"{e.a.name}__id"))
        if ta is None:
            a, ta = self.typed(e.a, state)
        element = t.elementType if scalars.is_list(t) else T.StringType()
        if type(element) is not type(ta):
            kind = scalars.common([element, ta])
            items, a = items.cast(T.ArrayType(kind)), a.cast(kind)
        return F.array_contains(items, a)

    def _case(self, e, state):
        pairs = [(s.Binary("=", e.subject, w) if e.subject is not None else w, t) for w, t in e.whens]
        results = [self.typed(t, state) for _, t in pairs]
        default = self.typed(e.default, state) if e.default is not None else (F.lit(None), T.NullType())
        kind = scalars.common([t for _, t in [*results, default]])
        out = None
        for (w, _), (col, _) in zip(pairs, results, strict=True):
            out = (F if out is None else out).when(self.boolean(w, state), col.cast(kind))
        return out.otherwise(default[0].cast(kind)), kind

    def _listlit(self, e, state):
        if not e.items:
            return F.array().cast("array<string>"), T.ArrayType(T.StringType())
        items = [self.typed(x, state) for x in e.items]
        kind = scalars.common([t for _, t in items])
        same = all(t == kind for _, t in items)
        return F.array(*[c if same else c.cast(kind) for c, _ in items]), T.ArrayType(kind)

    def _maplit(self, e, state):
        items = [(k, *self.typed(v, state)) for k, v in e.items]
        if not items:
            return F.lit("{}"), T.StringType()
        return F.struct(*[c.alias(k) for k, c, _ in items]), T.StructType([T.StructField(k, t) for k, _, t in items])

    def _projection(self, e, state):
        items = []
        for k, x in e.items:
            if k == "*":
                stem = f"{e.var}__p_"
                items += [(c[len(stem) :], s.Prop(s.Var(e.var), c[len(stem) :])) for c in state.df.columns if c.startswith(stem)]
            else:
                items.append((k, x if x is not None else s.Prop(s.Var(e.var), k)))
        return self._maplit(s.MapLit(tuple(items)), state)

    def inside(self, var: str, t: T.DataType, state: State, col: Column) -> State:
        return replace(state, scope=state.scope | {var: Bound("lambda", column=col, type=t)})

    def listed(self, e: s.Expr, state: State) -> tuple[Column, T.DataType]:
        col, t = self.typed(e, state)
        return (col, t) if scalars.is_list(t) else (F.array().cast("array<string>"), T.ArrayType(T.StringType()))

    def _comprehension(self, e, state):
        col, t = self.listed(e.source, state)
        if e.where is not None:
            col = F.filter(col, lambda x: self.boolean(e.where, self.inside(e.var, t.elementType, state, x)))
        if e.result is not None:
            kinds = []

            def each(x):
                out, kind = self.typed(e.result, self.inside(e.var, t.elementType, state, x))
                kinds.append(kind)
                return out

            col = F.transform(col, each)
            t = T.ArrayType(kinds[0])
        return col, t

    def _quantifier(self, e, state):
        col, t = self.listed(e.source, state)
        test = lambda x: self.boolean(e.where, self.inside(e.var, t.elementType, state, x))
        if e.kind == "all":
            return F.forall(col, test), T.BooleanType()
        if e.kind == "single":
            return F.size(F.filter(col, test)) == 1, T.BooleanType()
        found = F.exists(col, test)
        return (found if e.kind == "any" else ~found), T.BooleanType()

    def _reduce(self, e, state):
        col, t = self.listed(e.source, state)
        start, kind = self.typed(e.start, state)
        kind = scalars.common([kind, t.elementType]) if isinstance(kind, T.NumericType) else kind

        def step(acc, x):
            inner = self.inside(e.var, t.elementType, self.inside(e.acc, kind, state, acc), x)
            return self.expr(e.step, inner)[0].cast(kind)

        return F.aggregate(col, start.cast(kind), step), kind

    def _call(self, e, state):
        if self.is_aggregate(e):
            raise QueryError(f"{e.name} can't stand here")
        arg = e.args[0] if e.args else None
        b = state.scope.get(arg.name) if isinstance(arg, s.Var) else None
        if b and b.what == "node":
            v = arg.name
            if e.name in ("id", "elementid"):
                return F.col(f"{v}__id"), T.StringType()
            if e.name == "labels":
                more = F.lit(None).cast("array<string>")
                for kind, names in self.graph.more_labels.items():
                    more = F.when(F.col(f"{v}__kind") == kind, F.array(*[F.lit(x) for x in names])).otherwise(more)
                one = F.array(F.col(f"{v}__kind"))
                return F.when(F.col(f"{v}__kind").isNotNull(), F.coalesce(F.concat(one, more), one)), T.ArrayType(T.StringType())
            if e.name == "keys":
                own = [c for c in state.df.columns if c.startswith(f"{v}__p_")]
                return F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit("kind" if c.endswith("__p_own_kind") else c[len(v) + 4 :])) for c in own])), T.ArrayType(T.StringType())
            if e.name == "properties":
                return self.node_value(v, state.df)["properties"], None
        if b and b.what == "rel":
            v = arg.name
            if e.name == "type":
                return F.col(f"{v}__kind"), T.StringType()
            if e.name in ("startnode", "endnode"):
                return F.col(f"{v}__{'src' if e.name == 'startnode' else 'dst'}"), T.LongType()
            if e.name in ("id", "elementid"):
                return F.xxhash64(f"{v}__src", f"{v}__kind", f"{v}__dst"), T.LongType()
            if e.name == "properties":
                return self.rel_value(v, state.df)["properties"], None
        if b and b.what == "path":
            if e.name in ("length", "size"):
                return F.col(f"{arg.name}__len").cast("long"), T.LongType()
            if e.name == "nodes":
                return F.col(f"{arg.name}__ids"), T.ArrayType(T.StringType())
            if e.name in ("relationships", "rels"):
                if f"{arg.name}__rels" not in state.df.columns:
                    raise QueryError("relationships() takes a path of fixed length")
                return F.col(f"{arg.name}__rels"), None
        if e.name == "exists":
            return self.expr(arg, state)[0].isNotNull(), T.BooleanType()
        if e.name == "type" and arg is not None:
            return self.typed(s.Prop(arg, "type"), state)
        cols = [self.typed(a, state) for a in e.args]
        return scalars.call(e.name, [c for c, _ in cols], [t for _, t in cols])
