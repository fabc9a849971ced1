"""Logical queries to DataFrames.

Every pattern becomes a DataFrame whose columns are its variables; patterns are joined on shared names
and Catalyst orders, pushes down and picks the physical joins. Rules of its own:

- constants are filters on the property's table, so they reach the Parquet scan;
- a path to or from a constant is followed from the constant, level by level, not computed for all pairs;
- a pattern that only tests existence becomes a left semi join where the result is a set;
- a separate pattern that meets the rest in one inequality is reduced to its least or greatest value,
  one row, instead of a nested-loop join of two sides that grow;
- parts that nothing connects are refused: their product is asked for by a flag.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.paths import closure, reach, reach_few
from ..runtime import numbers_frame
from .algebra import AnyOf, Absent, Agg, Alt, Bind, Call, Ent, Filter, Inv, Label, Lit, Maybe, Other, Prop, Query, Repeat, Seq, Stmt, Sub, Triple, Unsupported, Values, Var, variables
from .catalog import Graph

UNIT = "__unit"
#: Nodes up to which a path's ends are a filter instead of a join.
FEW = 1000


@dataclass
class Frame:
    df: DataFrame
    kinds: dict[str, str]

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if c != UNIT]


class Planner:
    def __init__(self, graph: Graph, products: bool = False):
        self.graph, self.products = graph, products

    # Paths

    def kind(self, path, end: str) -> str:
        """Kind of the value at a path's end "v" or start "s"."""
        if isinstance(path, Prop):
            return self.graph.property(path.pid).kind if end == "v" else "entity"
        if isinstance(path, Seq):
            return self.kind(path.parts[-1] if end == "v" else path.parts[0], end)
        if isinstance(path, Alt):
            return self.kind(path.parts[0], end)
        if isinstance(path, Inv):
            return self.kind(path.path, "s" if end == "v" else "v")
        if isinstance(path, Other):
            return "entity"
        return self.kind(path.path, end)

    def pairs(self, path) -> DataFrame:
        """[s, v] of a path; sequences keep multiplicity, closures are sets."""
        if isinstance(path, Prop):
            return self.graph.edges(path.pid)
        if isinstance(path, Inv):
            return self.pairs(path.path).select(F.col("v").alias("s"), F.col("s").alias("v"))
        if isinstance(path, Alt):
            return reduce(DataFrame.union, map(self.pairs, path.parts))
        if isinstance(path, Other):
            return self.others(path)
        if isinstance(path, Repeat):
            return closure(self.pairs(path.path), path.zero)
        out = self.pairs(path.parts[0])
        for i, part in enumerate(path.parts[1:]):
            if isinstance(part, Repeat):  # only what is reached from here is followed
                starts = out.select(F.col("v").alias("n")).distinct()
                step = closure(self.pairs(part.path), starts=starts)
                if part.zero:  # every node is reached from itself, with or without an edge
                    step = step.union(starts.select(F.col("n").alias("s"), F.col("n").alias("v"))).distinct()
            else:
                step = self.pairs(part)
            out = out.withColumnRenamed("v", "__m").join(step.select(F.col("s").alias("__m"), "v"), "__m").select("s", "v")
        return out

    def others(self, path: Other) -> DataFrame:
        """[s, v] of the entity-valued properties that are not in a set; those of a set of inverse ones the other way round."""
        edges = self.graph.all_edges()
        out = [edges.filter(~F.col("pid").isin(*path.pids)).select("s", "v")] if path.pids else []
        if path.back is not None:
            out.append(edges.filter(~F.col("pid").isin(*path.back)).select(F.col("v").alias("s"), F.col("s").alias("v")))
        return reduce(DataFrame.union, out)

    def ends(self, path, start, backward: bool) -> DataFrame:
        """[n], or a list of few nodes: where a path leads from a constant or from nodes; backward, from where it leads there.

        Few nodes stay a list, as a filter by them reaches the scans and cuts off branches of unions.
        """
        if isinstance(path, Inv):
            return self.ends(path.path, start, not backward)
        if isinstance(path, Seq):
            for part in reversed(path.parts) if backward else path.parts:
                start = self.ends(part, start, backward)
            return start
        if isinstance(path, Alt):
            return reduce(DataFrame.union, [self.nodes(self.ends(p, start, backward)) for p in path.parts])
        if isinstance(path, Repeat):
            pairs = self.pairs(path.path)
            if not isinstance(start, DataFrame):
                ids = start if isinstance(start, list) else [start.id]
                few = reach_few(pairs, ids, backward, path.zero)
                if few is not None and len(few) <= FEW:
                    return few
            return reach(pairs, self.nodes(start), backward, path.zero)
        near, far = ("v", "s") if backward else ("s", "v")
        pairs = self.others(path) if isinstance(path, Other) else self.graph.edges(path.pid)
        edges = pairs.select(F.col(near).alias("a"), F.col(far).alias("n"))
        if isinstance(start, DataFrame):
            return edges.join(start.select(F.col("n").alias("a")), "a").select("n")
        if isinstance(start, list):
            return edges.filter(F.col("a").isin(start)).select("n")
        return edges.filter(F.col("a") == self.constant(start)).select("n")

    def nodes(self, start) -> DataFrame:
        if isinstance(start, DataFrame):
            return start
        return numbers_frame(self.graph.spark, n=start if isinstance(start, list) else [start.id])

    @staticmethod
    def constant(term) -> Column:
        return F.lit(term.id).cast("bigint") if isinstance(term, Ent) else F.lit(term.value)

    # Patterns

    def pattern(self, p) -> Frame:
        if isinstance(p, Triple):
            return self.triple(p)
        if isinstance(p, Stmt):
            return self.statement(p)
        if isinstance(p, Label):
            labels = self.graph.labels().select(F.col("id").alias("__s"), F.col("label").alias("__v"))
            return self.bound(labels, [("__s", p.of, "entity"), ("__v", p.text, "value")])
        if isinstance(p, AnyOf):
            parts = [self.group(g) for g in p.groups]
            names = sorted(set.intersection(*(set(f.names) for f in parts)))
            return Frame(reduce(DataFrame.union, [f.df.select(*names) for f in parts]), parts[0].kinds)
        if isinstance(p, Values):
            if isinstance(p.terms[0], Ent):
                return Frame(numbers_frame(self.graph.spark, **{p.var.name: [t.id for t in p.terms]}), {p.var.name: "entity"})
            values = [(t.value,) for t in p.terms]
            kind = "string" if isinstance(values[0][0], str) else "double"
            return Frame(self.graph.spark.createDataFrame(values, f"`{p.var.name}` {kind}"), {p.var.name: "value"})
        if isinstance(p, Sub):
            df = self.run(p.query, show=False)
            return df
        raise Unsupported(f"pattern {p}")

    def bound(self, df: DataFrame, terms: list[tuple]) -> Frame:
        """Columns filtered by constants, renamed to variables; the same variable twice is an equality."""
        names: dict[str, str] = {}
        kinds, out = {}, []
        for column, term, kind in terms:
            if not isinstance(term, Var):
                df = df.filter(F.col(column) == self.constant(term))
            elif term.name in names:
                df = df.filter(F.col(column) == F.col(names[term.name]))
            else:
                names[term.name] = column
                kinds[term.name] = kind
                out.append(F.col(column).alias(term.name))
        return Frame(df.select(*out) if out else df.select(F.lit(1).alias(UNIT)), kinds)

    def triple(self, t: Triple) -> Frame:
        path = t.path
        for pid in [path.pid] if isinstance(path, Prop) else []:
            if pid in self.graph.abstract:
                return self.abstract(t, pid)
            if pid in self.graph.transitive:
                path = Repeat(path, False)
        s, o = t.s, t.o
        if isinstance(path, (Seq, Repeat)) and not (isinstance(s, Var) and isinstance(o, Var)):
            if isinstance(o, Var):
                nodes = self.nodes(self.ends(path, s, False))
                return Frame(nodes.select(F.col("n").alias(o.name)), {o.name: self.kind(path, "v")})
            nodes = self.nodes(self.ends(path, o, True))
            if isinstance(s, Var):
                return Frame(nodes.select(F.col("n").alias(s.name)), {s.name: "entity"})
            return Frame(nodes.filter(F.col("n") == self.constant(s)).select(F.lit(1).alias(UNIT)), {})
        pairs = self.pairs(path).select(F.col("s").alias("__s"), F.col("v").alias("__v"))
        return self.bound(pairs, [("__s", s, "entity"), ("__v", o, self.kind(path, "v"))])

    def abstract(self, t: Triple, pid: str) -> Frame:
        """A property that stands for several: all their values, or for each entity those of the first that it has."""
        a = self.graph.abstract[pid]
        kind = self.graph.property(a.members[0]).kind
        tagged = reduce(DataFrame.union, [self.graph.edges(m).select("s", "v", F.lit(i).alias("rank")) for i, m in enumerate(a.members) if m in self.graph.properties])
        if a.mode == "any":
            first = tagged.groupBy("s").agg(F.min("rank").alias("rank"))
            tagged = tagged.join(first, ["s", "rank"], "left_semi")
        return self.bound(tagged.select(F.col("s").alias("__s"), F.col("v").alias("__v")), [("__s", t.s, "entity"), ("__v", t.o, kind)])

    def statement(self, p: Stmt) -> Frame:
        own = self.graph.property(p.pid)
        df, terms = self.graph.statements(p.pid), [("s", p.s, "entity")]
        for q in [*(q for q, _ in p.qualifiers), *p.absent]:
            if q not in own.qualifiers:
                raise Unsupported(f"{p.pid} has no qualifier {q}")
        for q in p.absent:
            df = df.filter(F.col(f"q_{q}").isNull())
        df = df.filter(F.col("v").isNotNull())
        if p.value is not None:
            terms.append(("v", p.value, own.kind))
        for q, term in p.qualifiers:
            df = df.filter(F.col(f"q_{q}").isNotNull())
            terms.append((f"q_{q}", term, own.qualifiers[q]))
        df = df.select(*[F.col(c).alias(f"__{c}") for c in dict.fromkeys(c for c, _, _ in terms)])
        return self.bound(df, [(f"__{c}", term, kind) for c, term, kind in terms])

    # Groups

    def group(self, patterns: tuple, needed: set[str] | None = None) -> Frame:
        """Joined patterns. needed: the variables used outside, if rows may be treated as a set; None keeps multiplicity."""
        plain = [p for p in patterns if isinstance(p, (Triple, Stmt, Label, AnyOf, Values, Sub))]
        rest = [x for p in patterns if p not in plain for x in self.conditions(p)]
        used = None if needed is None else needed | variables(tuple(rest))
        out = self.joined(plain, used, rest)
        for p in rest:
            if isinstance(p, Maybe):
                out = self.meet(out, self.group(p.group), "left")
            elif isinstance(p, Bind):
                out = Frame(out.df.withColumn(p.var.name, self.expr(p.expr)), out.kinds | {p.var.name: self.expr_kind(p.expr, out.kinds)})
        for p in rest:
            if isinstance(p, Filter) and p not in self.taken:
                out = Frame(out.df.filter(self.expr(p.expr)), out.kinds)
            elif isinstance(p, Absent):
                out = self.meet(out, self.group(p.group), "left_anti")
        return out

    def conditions(self, p) -> list:
        """A filter by several conditions that must all hold as one filter for each."""
        if isinstance(p, Filter) and isinstance(p.expr, Call) and p.expr.name == "&&":
            return [x for e in p.expr.args for x in self.conditions(Filter(e))]
        return [p]

    def joined(self, patterns: list, used: set[str] | None, rest: list) -> Frame:
        self.taken: list = getattr(self, "taken", [])
        if not patterns:
            raise Unsupported("a group without patterns")
        # Constants first, then whatever is connected; Catalyst may order anew.
        todo = sorted(patterns, key=lambda p: len(variables(p)))
        parts: list[tuple[Frame, set[str]]] = []
        while todo:
            p = todo.pop(0)
            frame, names = self.pattern(p), variables(p)
            while near := next((q for q in todo if variables(q) & names), None):
                todo.remove(near)
                others = set().union(*(variables(q) for q in todo))
                new = variables(near) - names
                if used is not None and not new & (used | others):
                    frame = self.meet(frame, self.pattern(near), "left_semi")
                else:
                    frame = self.meet(frame, self.pattern(near), "inner")
                names |= variables(near)
            parts.append((frame, names))
        # The part with most of what is asked for leads; the others join it.
        parts.sort(key=lambda x: -len(x[1] & (used or x[1])))
        out = parts[0][0]
        for frame, names in parts[1:]:
            out = self.apart(out, frame, used, rest)
        return out

    def apart(self, out: Frame, frame: Frame, used: set[str] | None, rest: list) -> Frame:
        """A part that shares no variable with the rest."""
        names = set(frame.names)
        touching = [f for f in rest if isinstance(f, Filter) and variables(f) & names]
        if used is not None and len(names & set().union(*map(variables, rest), set())) <= 1 and len(touching) == 1 and isinstance(touching[0].expr, Call):
            name, args = touching[0].expr.name, touching[0].expr.args
            if name in ("<", "<=", ">", ">=") and all(isinstance(a, Var) for a in args):
                mine = next(a.name for a in args if a.name in names)
                less = (name[0] == "<") == (args[0].name == mine)
                self.taken.append(touching[0])
                edge = frame.df.agg((F.min if less else F.max)(mine).alias(mine))
                return Frame(out.df.join(F.broadcast(edge), self.expr(touching[0].expr)).select(*out.df.columns), out.kinds)
        if not names:
            exists = frame.df.limit(1)
            return Frame(out.df.join(F.broadcast(exists.select(F.lit(1).alias("__e"))), F.lit(True), "left_semi"), out.kinds)
        conditions = [self.expr(f.expr) for f in touching if variables(f) <= names | set(out.names)]
        if not conditions and not self.products:
            raise Unsupported(f"parts of a query that share neither a variable nor a condition: {', '.join(sorted(names))}")
        self.taken += [f for f in touching if variables(f) <= names | set(out.names)]
        return Frame(out.df.join(frame.df, reduce(Column.__and__, conditions, F.lit(True))), out.kinds | frame.kinds)

    def meet(self, a: Frame, b: Frame, how: str) -> Frame:
        shared = [c for c in a.names if c in b.names]
        right = b.df.select(*b.names) if b.names else b.df
        if not shared:
            if how in ("left_semi", "inner") and not b.names:
                return Frame(a.df.join(F.broadcast(right.limit(1).select(F.lit(1).alias("__e"))), F.lit(True), "left_semi"), a.kinds)
            if how == "left_anti":
                return Frame(a.df.join(F.broadcast(right.limit(1).select(F.lit(1).alias("__e"))), F.lit(True), "left_anti"), a.kinds)
            if not self.products:
                raise Unsupported(f"an optional part that shares no variable with the rest: {', '.join(b.names)}")
            return Frame(a.df.join(right, F.lit(True), how), a.kinds | b.kinds)
        return Frame(a.df.join(right, shared, how), a.kinds if how in ("left_semi", "left_anti") else b.kinds | a.kinds)

    # Expressions

    def expr(self, e) -> Column:
        if isinstance(e, Var):
            return F.col(f"`{e.name}`")
        if isinstance(e, (Ent, Lit)):
            return self.constant(e)
        a = [self.expr(x) for x in e.args]
        match e.name:
            case "=" | "==":
                return a[0] == a[1]
            case "!=":
                return a[0] != a[1]
            case "<":
                return a[0] < a[1]
            case "<=":
                return a[0] <= a[1]
            case ">":
                return a[0] > a[1]
            case ">=":
                return a[0] >= a[1]
            case "&&":
                return reduce(Column.__and__, a)
            case "||":
                return reduce(Column.__or__, a)
            case "!":
                return ~a[0]
            case "bound":
                return a[0].isNotNull()
            case "year":
                return F.year(a[0])
            case "lcase":
                return F.lower(a[0].cast("string"))
            case "str":
                return a[0].cast("string")
            case "strstarts":
                return a[0].startswith(a[1])
            case "contains":
                return a[0].contains(a[1])
            case "replace":
                return F.regexp_replace(a[0], e.args[1].value, e.args[2].value)
            case "coalesce":
                return F.coalesce(*a)
            case "regex":
                return a[0].rlike(("(?i)" if len(e.args) > 2 and "i" in e.args[2].value else "") + e.args[1].value)
        raise Unsupported(f"function {e.name}")

    def expr_kind(self, e, kinds: dict[str, str]) -> str:
        if isinstance(e, Var):
            return kinds.get(e.name, "value")
        if isinstance(e, Call) and e.name == "coalesce":
            return self.expr_kind(e.args[0], kinds)
        return "entity" if isinstance(e, Ent) else "value"

    # Queries

    def run(self, q: Query, show: bool = True):
        """The query's result; with show, entities as Q numbers and one column for each projection."""
        self.taken = []
        aggregates = [x for x in q.select if isinstance(x, Agg)]
        plain = [x for x in q.select if isinstance(x, Var)]
        wanted = {x.name for x in plain} | {a.var.name for a in aggregates if a.var} | {v.name for v in q.group_by} | variables(q.order) | variables(q.having)
        as_set = q.ask or (q.distinct and not aggregates and not q.having and not q.group_by) or (aggregates and all(a.distinct or a.op in ("min", "max") for a in aggregates) and not q.having)
        frame = self.group(tuple(q.where), wanted if as_set else None)
        df = frame.df
        if q.ask:
            return df.limit(1).agg((F.count("*") > 0).alias("answer"))
        kinds = dict(frame.kinds)
        if q.group_by or aggregates or q.having:
            keys = [v.name for v in (q.group_by or plain)]
            aggs, conditions, orders = [self.aggregate(a).alias(a.alias) for a in aggregates], [], []
            for i, (a, op, n) in enumerate(q.having):
                aggs.append(self.aggregate(a).alias(f"__h{i}"))
                conditions.append(self.expr(Call(op, (Var(f"__h{i}"), Lit(n)))))
            order = []
            for i, (by, desc) in enumerate(q.order):
                if isinstance(by, Agg):
                    aggs.append(self.aggregate(by).alias(f"__o{i}"))
                    order.append((f"__o{i}", desc))
                elif by.name in keys or by.name in {a.alias for a in aggregates}:
                    order.append((by.name, desc))
                else:
                    aggs.append((F.max if desc else F.min)(by.name).alias(f"__o{i}"))
                    order.append((f"__o{i}", desc))
            df = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
            for c in conditions:
                df = df.filter(c)
            names = [x.alias if isinstance(x, Agg) else x.name for x in q.select]
            tie = keys
        else:
            names = [v.name for v in plain]
            order, tie = [], names
            if q.order:  # DISTINCT with an order by something else: that is aggregated for each result
                aggs = []
                for i, (by, desc) in enumerate(q.order):
                    if by.name in names:
                        order.append((by.name, desc))
                    else:
                        aggs.append((F.max if desc else F.min)(by.name).alias(f"__o{i}"))
                        order.append((f"__o{i}", desc))
                df = df.groupBy(*names).agg(*aggs) if aggs else df.select(*names).distinct()
            else:
                df = df.select(*names)
                df = df.distinct() if q.distinct else df
        if q.order or q.limit is not None or q.offset:
            columns = [F.desc_nulls_last(c) if desc else F.asc_nulls_first(c) for c, desc in order] + [F.asc(c) for c in tie]
            df = df.orderBy(*columns)
            df = df.offset(q.offset) if q.offset else df
            df = df.limit(q.limit) if q.limit is not None else df
        df = df.select(*names)
        if not show:
            return Frame(df, {n: kinds.get(n, "value") for n in names})
        return df.select(*[F.concat(F.lit("Q"), F.col(n).cast("string")).alias(n) if kinds.get(n) == "entity" else F.col(n) for n in names])

    @staticmethod
    def aggregate(a: Agg) -> Column:
        if a.op == "count":
            if a.var is None:
                return F.count("*")
            return F.countDistinct(a.var.name) if a.distinct else F.count(a.var.name)
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.op](a.var.name)


def run(graph: Graph, query: Query, products: bool = False) -> DataFrame:
    """The query's result. A query whose parts share neither a variable nor a condition is refused, unless `products` asks for every combination."""
    return Planner(graph, products).run(query)
