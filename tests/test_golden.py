"""Small programs with known memory graphs."""

import pytest

from cellgraph.operators import interproc
from cellgraph.operators.local import Program
from cellgraph.operators.unify import memory_only
from cellgraph.schema import EDB, FLAG, flag_letters


def program(spark, **rows):
    tables = {}
    for name, given in rows.items():
        names = EDB[name].names
        tables[name] = spark.createDataFrame([tuple(r.get(c) for c in names) for r in given], EDB[name])
    return Program(spark, **tables)


def shapes(m):
    """Sorted (types, flags, number of links) of the memory nodes."""
    nodes = memory_only(m).select("node", flag_letters(memory_only(m)["flags"]).alias("letters")).collect()
    types, links = {}, {}
    for r in m.accessed.collect():
        types.setdefault(r.node, set()).add((r.off, r.type))
    for r in m.link.collect():
        links[r.node] = links.get(r.node, 0) + 1
    return sorted((tuple(sorted(types.get(n.node, ()))), n.letters, links.get(n.node, 0)) for n in nodes)


def test_phi(spark):
    tmp, a, b, res, tmp6, tmp7 = range(1, 7)
    i32, p32 = {"type": "i32", "bytes": 4}, {"type": "i32*", "bytes": 8}
    p = program(
        spark,
        func=[{"func": 1, "is_main": True, "name": "main"}],
        i_alloca=[{"func": 1, "val": v} for v in (tmp, a, b, res)],
        i_store=[{"func": 1, "ptr": v, **i32} for v in (tmp, a, b)] + [{"func": 1, "ptr": res, "val": tmp6, **p32}],
        i_load=[{"func": 1, "ptr": tmp, **i32}, {"func": 1, "dst": tmp7, "ptr": res, **p32}, {"func": 1, "ptr": tmp7, **i32}],
        i_phi=[{"func": 1, "dst": tmp6, "src": a}, {"func": 1, "dst": tmp6, "src": b}],
    )
    m = interproc.context_insensitive(p)
    assert shapes(m) == [(((0, "i32"),), "SMR", 0), (((0, "i32"),), "SMR", 0), (((0, "i32*"),), "SMR", 1)]
    at = {r.val: r.node for r in m.cell.filter("kind = 'scalar'").collect()}
    assert at[a] == at[b] == at[tmp6] == at[tmp7] != at[tmp] and m.link.first().dst == at[a]


def test_two_contexts(spark):
    """f(x, y) stores through both; g passes two pairs on; main merges x and y."""
    x, y, p_, q, r, s, mx, my, mw, mz, xy = range(1, 12)
    i32 = {"type": "i32", "bytes": 4}
    prog = program(
        spark,
        func=[{"func": 1, "name": "f"}, {"func": 2, "name": "g"}, {"func": 3, "name": "main", "is_main": True}],
        formal=[{"func": 1, "idx": 0, "val": x}, {"func": 1, "idx": 1, "val": y}] + [{"func": 2, "idx": i, "val": v} for i, v in enumerate((p_, q, r, s))],
        i_store=[{"func": 1, "ptr": x, **i32}, {"func": 1, "ptr": y, **i32}],
        i_alloca=[{"func": 3, "val": v} for v in (mx, my, mw, mz)],
        i_select=[{"func": 3, "dst": xy, "a": mx, "b": my}],
        i_call=[{"cs": 1, "func": 2, "callee": 1}, {"cs": 2, "func": 2, "callee": 1}, {"cs": 3, "func": 3, "callee": 2}],
        i_actual=[{"cs": 1, "idx": 0, "val": p_}, {"cs": 1, "idx": 1, "val": q}, {"cs": 2, "idx": 0, "val": r}, {"cs": 2, "idx": 1, "val": s}] + [{"cs": 3, "idx": i, "val": v} for i, v in enumerate((xy, my, mw, mz))],
    )
    at = {r.val: r.node for r in interproc.context_insensitive(prog).cell.collect()}
    assert len({at[v] for v in (xy, mx, my, mw, mz, x, y)}) == 1  # all callers share f's parameters
    assert interproc.flat(prog).first().flags & FLAG["modified"]
    local = {r.val: r.node for r in interproc.intra(prog).cell.collect()}
    assert local[mw] != local[mz] != local[mx] and local[mx] == local[my]


@pytest.mark.parametrize("stride,off,collapsed", [(8, 8, False), (8, 4, True)])
def test_arrays(spark, stride, off, collapsed):
    """A variable step makes an array; a second pointer at a multiple of it fits, one across its elements collapses it."""
    base, i, j = 1, 2, 3
    p = program(
        spark,
        func=[{"func": 1, "is_main": True}],
        i_alloca=[{"func": 1, "val": base}],
        i_gep=[{"func": 1, "dst": i, "base": base, "const_off": 0, "stride": stride}, {"func": 1, "dst": j, "base": base, "const_off": off, "stride": 0}],
        i_store=[{"func": 1, "ptr": j, "type": "i64", "bytes": 8}, {"func": 1, "ptr": i, "type": "i64", "bytes": 8}],
    )
    n = memory_only(interproc.context_insensitive(p)).collect()
    assert len(n) == 1 and n[0].collapsed == collapsed and bool(n[0].flags & FLAG["array"]) != collapsed


def test_collapse_by_specification(spark):
    p = program(
        spark,
        func=[{"func": 1, "is_main": True}],
        i_alloca=[{"func": 1, "val": 1}],
        i_store=[{"func": 1, "ptr": 1, "type": "i32", "bytes": 4}],
        spec_call=[{"cs": 1, "func": 1, "kind": "collapse", "arg0": 1}, {"cs": 2, "func": 1, "kind": "set_external", "arg0": 1}],
    )
    n = memory_only(interproc.context_insensitive(p)).first()
    assert n.collapsed and n.size == 1 and n.flags & FLAG["external"] and n.flags & FLAG["modified"]
