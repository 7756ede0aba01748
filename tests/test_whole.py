"""Analyses with contexts: small programs whose graphs are known."""

import pytest
from test_golden import program

from cellgraph.operators import interproc
from cellgraph.schema import FLAG

I32 = {"type": "i32", "bytes": 4}


def two_contexts():
    """f stores through both parameters; g passes its first two and its last two on; main merges x and y only."""
    x, y, p, q, r, s, mx, my, mw, mz, xy = range(1, 12)
    return dict(
        func=[{"func": 1, "name": "f"}, {"func": 2, "name": "g"}, {"func": 3, "name": "main", "is_main": True}],
        formal=[{"func": 1, "idx": 0, "val": x}, {"func": 1, "idx": 1, "val": y}] + [{"func": 2, "idx": i, "val": v} for i, v in enumerate((p, q, r, s))],
        i_store=[{"func": 1, "ptr": x, **I32}, {"func": 1, "ptr": y, **I32}], i_alloca=[{"func": 3, "val": v} for v in (mx, my, mw, mz)], i_select=[{"func": 3, "dst": xy, "a": mx, "b": my}],
        i_call=[{"cs": 1, "func": 2, "callee": 1}, {"cs": 2, "func": 2, "callee": 1}, {"cs": 3, "func": 3, "callee": 2}],
        i_actual=[{"cs": 1, "idx": 0, "val": p}, {"cs": 1, "idx": 1, "val": q}, {"cs": 2, "idx": 0, "val": r}, {"cs": 2, "idx": 1, "val": s}] + [{"cs": 3, "idx": i, "val": v} for i, v in enumerate((xy, my, mw, mz))],
    )


@pytest.fixture(scope="module")
def contexts(spark):
    return program(spark, **two_contexts())


def at(m, graph=None):
    rows = m.cell.collect()
    return {r.val: (r.graph, r.node) for r in rows if graph is None or r.graph == graph}


def test_bottom_up_keeps_callers_apart(contexts):
    n = at(interproc.bottom_up(contexts))
    x, y, p, q, r, s, mx, my, mw, mz, xy = (n[v] for v in range(1, 12))
    assert len({x, y}) == 2 and len({p, q, r, s}) == 4 and mx == my == xy and len({xy, mw, mz}) == 3


def test_top_down_brings_merges_to_callees(contexts):
    m = interproc.bottom_up_top_down(contexts)
    n = at(m)
    x, y, p, q, r, s, mx, my, mw, mz, xy = (n[v] for v in range(1, 12))
    assert p == q and r != s and x == y  # f is told of one caller's merge; bottom-up is not repeated
    assert len({xy, mw, mz}) == 3 and {r.graph for r in m.node.collect()} == {1, 2, 3}


def test_context_sensitive_settles(contexts):
    m = interproc.context_sensitive(contexts)
    n = at(m)
    x, y, p, q, r, s, mx, my, mw, mz, xy = (n[v] for v in range(1, 12))
    assert x == y and p == q != r and r == s and mx == my == xy and mw == mz != xy
    flags = {(r.graph, r.node): r.flags for r in m.node.collect()}
    assert all(flags[v] & FLAG["modified"] for v in (x, p, r, xy, mw))
    sites = {(r.graph, r.node, r.val) for r in m.site.collect()}
    assert all({v for g, k, v in sites if (g, k) == node} == {7, 8, 9, 10} for node in (x, p, r, xy, mw))  # f's one node stands for all, and sites agree along calls both ways


def test_queries_about_graphs(contexts):
    g = interproc.Graphs(contexts, interproc.bottom_up(contexts))
    assert g.has(1) and not g.has(99) and {r.graph for r in g.get(2).cell.collect()} == {2} and g.get(3).node.count() >= 3


def test_complete_call_graph_over_passes(spark):
    """main calls a pointer in its own stack; the callee it finds calls through a parameter; a wrong type is no callee."""
    main, foo, bar, odd = 1, 2, 3, 4
    p = program(
        spark,
        func=[{"func": main, "name": "main", "is_main": True}, {"func": foo, "name": "foo", "type": "v(p)"}, {"func": bar, "name": "bar", "type": "v()"}, {"func": odd, "name": "odd", "type": "i(i)"}],
        value=[{"val": 100, "kind": "func", "name": "foo", "is_ptr": True}, {"val": 101, "kind": "func", "name": "bar", "is_ptr": True}, {"val": 102, "kind": "func", "name": "odd", "is_ptr": True}],
        formal=[{"func": foo, "idx": 0, "val": 20}],
        i_alloca=[{"func": main, "val": 10}],
        i_store=[{"func": main, "ptr": 10, "val": 100, "type": "v(p)*", "bytes": 8}, {"func": main, "ptr": 10, "val": 102, "type": "v(p)*", "bytes": 8}],
        i_load=[{"func": main, "dst": 11, "ptr": 10, "type": "v(p)*", "bytes": 8}],
        i_call=[{"cs": 1, "func": main, "called_val": 11, "type": "v(p)"}, {"cs": 2, "func": foo, "called_val": 20, "type": "v()"}],
        i_actual=[{"cs": 1, "idx": 0, "val": 101}],
    )
    done, edges = interproc.complete_call_graph(p)
    assert {(r.cs, r.callee) for r in edges.collect()} == {(1, foo), (2, bar)}  # the second only once the first is an edge
    assert done["i_call"].count() == 4


def test_results_without_a_value_unify_nothing(spark):
    """Two functions that return null: their results stay apart, and meet nothing."""
    p = program(
        spark,
        func=[{"func": 1, "name": "f"}, {"func": 2, "name": "g"}, {"func": 3, "name": "main", "is_main": True}],
        value=[{"val": 50, "kind": "null", "is_ptr": True}],
        i_ret=[{"func": 1}, {"func": 2, "val": 50}],
        i_call=[{"cs": 1, "func": 3, "callee": 1, "ret_val": 10}, {"cs": 2, "func": 3, "callee": 2, "ret_val": 11}],
        i_store=[{"func": 3, "ptr": 10, **I32}, {"func": 3, "ptr": 11, **I32}],
    )
    assert interproc.argument_equations(p).count() == 0
    for mode in (interproc.context_insensitive, interproc.bottom_up):
        n = {r.val: r.node for r in mode(p).cell.collect()}
        assert n[10] != n[11]


def test_globals_meet_across_functions(spark):
    """A global that a callee writes and its initialiser's target are the caller's, too; two programs do not mix."""
    p = program(
        spark,
        func=[{"func": 1, "name": "set"}, {"func": 2, "name": "main", "is_main": True}, {"func": 7, "name": "other", "program": 1}],
        value=[{"val": 90, "kind": "global", "name": "g", "is_ptr": True}, {"val": 91, "kind": "global", "name": "h", "is_ptr": True}],
        global_init=[{"gv": 90, "off": 0, "target": 91}],
        i_store=[{"func": 1, "ptr": 90, "val": 5, "type": "i32*", "bytes": 8}, {"func": 2, "ptr": 91, **I32}],
        formal=[{"func": 1, "idx": 0, "val": 5}],
        i_alloca=[{"func": 2, "val": 6}, {"func": 7, "val": 60}],
        i_call=[{"cs": 1, "func": 2, "callee": 1}],
        i_actual=[{"cs": 1, "idx": 0, "val": 6}],
    )
    m = interproc.bottom_up(p)
    n = at(m, 2)
    links = {(r.graph, r.node): (r.graph, r.dst) for r in m.link.collect()}
    assert links[n[90]] in (n[6], n[91]) and at(m, 7)[60][0] == 7
    assert {r.val for r in m.site.filter("graph = 2").collect()} == {6, 90, 91}
