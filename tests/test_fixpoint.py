"""Distributed loops against the one-task solvers and small in-memory models."""

import random

from cellgraph.operators import callgraph, fixpoint


def edges_of(spark, pairs, a="a", b="b"):
    return spark.createDataFrame(pairs, f"{a} long, {b} long")


def test_components_both_ways(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    e = edges_of(spark, pairs)
    one, many = fixpoint.components(e), fixpoint.components(e, small=-1)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in many.collect()}


def test_components_of_nothing(spark):
    assert fixpoint.components(edges_of(spark, [])).count() == 0


def test_reach_both_ways(spark):
    rng = random.Random(2)
    e = edges_of(spark, [(rng.randrange(30), rng.randrange(30)) for _ in range(40)], "src", "dst")
    seeds = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "tag string, id long")
    one, many = fixpoint.reach(seeds, e), fixpoint.reach(seeds, e, small=-1)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in many.collect()}


def test_scc_and_levels_both_ways(spark):
    rng = random.Random(3)
    funcs = spark.createDataFrame([(i,) for i in range(12)], "func long")
    calls = edges_of(spark, [(rng.randrange(12), rng.randrange(12)) for _ in range(16)], "caller", "callee")
    one, many = callgraph.scc(funcs, calls), callgraph.scc(funcs, calls, small=-1)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in many.collect()}
    a, b = callgraph.levels(funcs, calls, one), callgraph.levels(funcs, calls, one, small=-1)
    assert {tuple(r) for r in a.select("func", "level").collect()} == {tuple(r) for r in b.select("func", "level").collect()}


def test_weighted_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    eq = spark.createDataFrame([(1, 8, 2, 0), (2, 4, 3, 0), (4, 0, 5, 0), (4, 8, 5, 0)], "n1 long, o1 long, n2 long, o2 long")
    for small in (fixpoint.SMALL, -1):
        got = {r.node: (r.rep, r.delta, r.conflict) for r in fixpoint.weighted_components(nodes, eq, small=small).collect()}
        assert (got[1], got[2], got[3]) == ((1, 0, False), (1, 8, False), (1, 12, False))
        assert got[4][2] and got[5][2] and got[6] == (6, 0, False)
