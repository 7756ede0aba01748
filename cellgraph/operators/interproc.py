"""Analyses over whole programs: context-insensitive, flat, per-function, bottom-up, top-down, context-sensitive, complete call graphs.

The context-insensitive analysis is one distributed fixpoint. The others have a
graph for each component of the call graph; each program is a group of rows that
one task solves (:mod:`cellgraph.operators.whole`), and a corpus of programs
(column ``program`` of the functions) is solved in as many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .callgraph import levels, positional, scc
from .fixpoint import cut
from .local import Program, facts, value_node
from .unify import MemoryGraph, solve
from .whole import SCHEMA, analysed

WHOLE = 0


def argument_equations(p: Program, whole: int = WHOLE) -> DataFrame:
    """Actual and formal pointer arguments, and results and returned values, are equal (all returns are unified); nulls are equal to nothing."""
    none = p["value"].filter("kind in ('null', 'undef')").select("val")
    args = positional(p["i_actual"].join(none, "val", "left_anti"), p["formal"], p["i_call"].select("cs", "callee"))
    returned = p["i_ret"].filter("val is not null").join(none, "val", "left_anti")
    back = p["i_call"].filter("ret_val is not null").select("callee", F.col("ret_val").alias("a")).join(returned.select(F.col("func").alias("callee"), F.col("val").alias("b")), "callee").select("a", "b")
    n = lambda c: value_node(F.lit(whole).cast("long"), F.col(c))
    zero = F.lit(0).cast("long")
    return args.union(back).select(n("a").alias("n1"), zero.alias("o1"), n("b").alias("n2"), zero.alias("o2")).distinct()


def context_insensitive(p: Program, type_aware: bool = True) -> MemoryGraph:
    """One graph for the whole program."""
    one = p["func"].select("func", F.lit(WHOLE).cast("long").alias("graph"))
    return solve(facts(p, one, type_aware), argument_equations(p))


def intra(p: Program, type_aware: bool = True) -> MemoryGraph:
    """A graph for each function, without calls."""
    return solve(facts(p, p["func"].select("func", F.col("func").alias("graph")), type_aware))


def flat(p: Program) -> DataFrame:
    """One node for all memory: flags, number of types, number of alloc sites."""
    f = facts(p, p["func"].select("func", F.lit(WHOLE).cast("long").alias("graph")), False)
    flags = f["flag"].agg(F.coalesce(F.bit_or("flags"), F.lit(0)).alias("flags"), F.lit(0).alias("k"))
    types = f["accessed"].agg(F.count_distinct("type").alias("types"), F.lit(0).alias("k"))
    sites = f["site"].agg(F.count_distinct("val").alias("sites"), F.lit(0).alias("k"))
    return flags.join(types, "k").join(sites, "k").select(F.lit(0).cast("long").alias("node"), "flags", "types", "sites")


def _pairs(p: Program, graph_of: DataFrame) -> DataFrame:
    """(cs, caller_graph, callee_graph, kind, a, b): caller value a stands for callee value b, by argument or result."""
    calls = p["i_call"].filter("callee is not null").select("cs", F.col("func").alias("caller"), "callee", "ret_val")
    calls = calls.join(graph_of.select(F.col("func").alias("caller"), F.col("graph").alias("caller_graph")), "caller").join(graph_of.select(F.col("func").alias("callee"), F.col("graph").alias("callee_graph"), F.col("level")), "callee")
    none = p["value"].filter("kind in ('null', 'undef') or not is_ptr").select("val")
    args = calls.join(p["i_actual"].join(none, "val", "left_anti"), "cs").join(p["formal"].select(F.col("func").alias("callee"), "idx", F.col("val").alias("b")), ["callee", "idx"]).select("cs", "caller_graph", "callee_graph", F.lit("formal").alias("kind"), F.col("val").alias("a"), "b")
    back = calls.filter("ret_val is not null").join(p["i_ret"].filter("val is not null").join(none, "val", "left_anti").select(F.col("func").alias("callee"), F.col("val").alias("b")), "callee").select("cs", "caller_graph", "callee_graph", F.lit("ret").alias("kind"), F.col("ret_val").alias("a"), "b")
    return args.union(back)


def _levels(p: Program) -> DataFrame:
    """(func, graph, level): components of the call graph share a graph."""
    calls = p["i_call"].filter("callee is not null").select(F.col("func").alias("caller"), "callee").distinct()
    funcs = p["func"].select("func")
    return cut(levels(funcs, calls, scc(funcs, calls)).select("func", F.col("scc").alias("graph"), "level").coalesce(max(1, int(p.spark.conf.get("spark.sql.shuffle.partitions")))))


def _rows(p: Program, type_aware: bool) -> DataFrame:
    """Facts, calls, levels and stack values of all programs as rows of one table (:data:`cellgraph.operators.whole.SCHEMA`)."""
    graph_of = _levels(p)
    f = facts(p, graph_of, type_aware)
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")

    def row(df, kind, a, b=none, c=none, d=none, s=text, g="graph"):
        col = lambda x: F.col(x).cast("long") if isinstance(x, str) else x
        return df.select(F.lit(kind).alias("kind"), F.col(g).alias("g"), col(a).alias("a"), col(b).alias("b"), col(c).alias("c"), col(d).alias("d"), (F.col(s) if isinstance(s, str) else s).alias("s"))

    out = row(f["eq"], "eq", "n1", "o1", "n2", "o2")
    out = out.union(row(f["link"], "link", "node", "off", "dst", "dst_off", "ftype")).union(row(f["flag"], "flag", "node", "flags")).union(row(f["accessed"], "accessed", "node", "off", "bytes", s="type"))
    out = out.union(row(f["site"], "site", "node", "val")).union(row(f["array"], "array", "node", "stride")).union(row(f["collapse"], "collapse", "node")).union(row(f["cell"], "cell", "val", "node", "off", s="kind"))
    out = out.union(row(_pairs(p, graph_of), "pair", "cs", "callee_graph", "a", "b", "kind", "caller_graph")).union(row(graph_of.select("graph", "level").distinct(), "level", "level"))
    out = out.union(row(p["i_alloca"].join(graph_of, "func"), "stack", "val"))
    home = p["func"].join(graph_of, "func").groupBy(F.col("graph").alias("g")).agg(F.coalesce(F.min("program"), F.lit(0)).cast("long").alias("program"))
    # a union has the partitions of all its parts
    return out.coalesce(max(1, int(p.spark.conf.get("spark.sql.shuffle.partitions")))).join(home, "g").select("program", "kind", "g", "a", "b", "c", "d", "s")


def _solved(rows: DataFrame, mode: str) -> MemoryGraph:
    done = cut(rows.groupBy("program").applyInArrow(analysed(mode), SCHEMA))
    of = lambda kind: done.filter(F.col("kind") == kind)
    g = F.col("g").alias("graph")
    node = of("node").select(g, F.col("a").alias("node"), F.col("b").cast("int").alias("flags"), F.col("c").alias("size"), F.col("d").alias("stride"), (F.col("s") == "collapsed").alias("collapsed"))
    link = of("link").select(g, F.col("a").alias("node"), F.col("b").alias("off"), F.col("s").alias("ftype"), F.col("c").alias("dst"), F.col("d").alias("dst_off"))
    accessed = of("accessed").select(g, F.col("a").alias("node"), F.col("b").alias("off"), F.col("s").alias("type"), F.col("c").alias("bytes"))
    cell = of("cell").select(g, F.col("s").alias("kind"), F.col("a").alias("val"), F.col("b").alias("node"), F.col("c").alias("off"))
    lab = node.select(F.col("node").alias("id"), "node", F.lit(0).cast("long").alias("off"))
    return MemoryGraph(node, link, accessed, of("site").select(g, F.col("a").alias("node"), F.col("b").alias("val")), cell, lab)


def bottom_up(p: Program, type_aware: bool = True) -> MemoryGraph:
    """Summaries, callees first: each call copies the callee's graph into the caller's and unifies arguments, results and globals.

    Functions of one component of the call graph share a graph; the stack of a callee leaves no sites behind. The tables have a column ``graph``.
    """
    return _solved(_rows(p, type_aware), "bottom-up")


def bottom_up_top_down(p: Program, type_aware: bool = True) -> MemoryGraph:
    """Bottom-up summaries, then what callers pass is copied down, callers first; what nothing reaches is removed."""
    return _solved(_rows(p, type_aware), "top-down")


def context_sensitive(p: Program, type_aware: bool = True) -> MemoryGraph:
    """Bottom-up summaries, then calls propagate up where their simulation fails or is no function, and down where it is not injective on modified nodes, until none does; sites agree along all calls."""
    return _solved(_rows(p, type_aware), "context-sensitive")


def resolved_edges(p: Program, m: MemoryGraph) -> DataFrame:
    """cs, callee: functions whose address the cell of an indirect call holds, in whatever graph, and whose type is the call's (or not known)."""
    site = m.site.join(p["value"].filter("kind = 'func'").select("val", "name"), "val")
    held = m.cell.filter("kind = 'callsite'").select("graph", F.col("val").alias("cs"), "node").join(site, ["graph", "node"])
    named = held.join(p["func"].select("name", F.col("func").alias("callee"), F.col("type").alias("has")), "name")
    wants = p["i_call"].filter("callee is null").select("cs", F.col("type").alias("wants"))
    return named.join(wants, "cs").filter("wants is null or has is null or wants = has").select("cs", "callee").distinct()


def complete_call_graph(p: Program, type_aware: bool = True) -> tuple[Program, DataFrame]:
    """The program with the calls that indirect call sites make, and those edges (cs, callee).

    Each pass analyses the program bottom-up with the edges found so far; call
    sites come up with their callees' graphs, so that a site is resolved where
    its function pointer is known. The loop ends when a pass finds no new edge.
    """
    calls, found = p["i_call"], None
    while True:
        now = Program(p.spark, **p.tables | {"i_call": calls})
        edges = cut(resolved_edges(now, bottom_up(now, type_aware)))
        if found is not None and edges.join(found, ["cs", "callee"], "left_anti").isEmpty():
            return now, found
        found = cut(edges if found is None else edges.union(found).distinct())
        open_ = p["i_call"].filter("callee is null")
        calls = cut(p["i_call"].unionByName(open_.drop("callee").join(found, "cs").select(*p["i_call"].columns)))


class Graphs:
    """Answers about solved graphs: which there are, and the tables of one function's graph."""

    def __init__(self, p: Program, m: MemoryGraph):
        self.of = cut(_levels(p).select("func", "graph"))
        self.m = m

    def has(self, func: int) -> bool:
        return not self.of.filter(F.col("func") == func).isEmpty()

    def get(self, func: int) -> MemoryGraph:
        """The tables of the graph that the function's component has."""
        own = self.of.filter(F.col("func") == func).select("graph")
        return MemoryGraph(*[getattr(self.m, t).join(own, "graph", "left_semi") for t in ("node", "link", "accessed", "site", "cell")], self.m.lab)
