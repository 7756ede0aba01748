"""Graphs above the size of one task, and long ones: small inputs with a small limit."""

from functools import partial

import numpy as np
from pyspark.sql import functions as F

from cellgraph.operators import callgraph, fixpoint, shadow, simulate, sites
from cellgraph.sources import specs


def chains(spark, n=12, length=12):
    """Edges (src, dst) of some chains: chain i has the ids from 100 * i."""
    return spark.range(n * length).select((F.floor(F.col("id") / length) * 100 + F.col("id") % length).alias("src")).select("src", (F.col("src") + 1).alias("dst"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_call_paths_of_any_length(spark):
    """A chain of callers beyond 10,000 steps, and a start with its cycles, both ways."""
    n = 10_050
    chain = spark.range(n).select(F.col("id").alias("callee"), (F.col("id") + 1).alias("caller"))
    start = spark.createDataFrame([(0,)], "func long")
    top = sites.call_paths(start, chain).agg(F.count(F.lit(1)), F.max(F.size("path")), F.max("func")).first()
    assert tuple(top) == (n + 1, n + 1, n)
    few = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3), (1, 3)], "callee long, caller long")
    one, many = (sorted(map(str, sites.call_paths(start.select((F.col("func") + 1).alias("func")), few, small=k).collect())) for k in (100, -1))
    assert one == many and len(one) == 6


def test_levels_count_different_calls(spark):
    """Calls that are repeated do not make a graph large."""
    funcs = spark.range(40).withColumnRenamed("id", "func")
    once = funcs.filter("func > 0").select(F.col("func").alias("caller"), (F.col("func") - 1).alias("callee"))
    calls = once.crossJoin(spark.range(50))
    got = callgraph.levels(funcs, calls, funcs.withColumn("scc", F.col("func")), max_rounds=3, small=200)
    assert {(r.func, r.level) for r in got.collect()} == {(i, i) for i in range(40)}


def test_reach_by_components(spark):
    """More edges than a task takes, in small components: no round for each step."""
    seeds = spark.createDataFrame([(7, 0), (7, 105), (8, 100), (9, 5000)], "tag long, id long")
    want = [(7, i) for i in range(13)] + [(7, 100 + i) for i in range(5, 13)] + [(8, 100 + i) for i in range(13)] + [(9, 5000)]
    assert rows(fixpoint.reach(seeds, chains(spark), max_rounds=3, small=50)) == sorted(want)
    named = fixpoint.reach(seeds.withColumn("tag", F.struct(F.lit("x"), "tag")), chains(spark), max_rounds=3, small=50).select("tag.tag", "id")
    assert rows(named) == sorted(want)


def test_reach_with_one_large_component(spark):
    """Components that fit go in parts, the one that does not in the loop."""
    edges = chains(spark, 4, 5).union(spark.range(1000, 1030).select("id", F.col("id") + 1))
    seeds = spark.createDataFrame([(1, 0), (1, 1000), (2, 1020)], "tag long, id long")
    assert rows(fixpoint.reach(seeds, edges, small=20)) == sorted([(1, i) for i in range(6)] + [(1, 1000 + i) for i in range(31)] + [(2, 1020 + i) for i in range(11)])


def test_regions_by_components(spark, monkeypatch):
    monkeypatch.setattr(shadow, "reach", partial(fixpoint.reach, max_rounds=3, small=50))
    links = chains(spark).withColumnRenamed("src", "node")
    got = shadow.regions(spark.createDataFrame([(1, 6)], "func long, node long"), spark.createDataFrame([(1, 3), (2, 110)], "func long, node long"), links)
    assert rows(got) == sorted([(1, i, "in") for i in range(6, 13)] + [(1, i, "out") for i in range(3, 6)] + [(2, i, "out") for i in range(110, 113)])


def test_summary_specs_by_components(spark, monkeypatch):
    monkeypatch.setattr(specs, "reach", partial(fixpoint.reach, max_rounds=3, small=50))
    links = chains(spark).select(F.col("src").alias("node"), F.lit(8).cast("long").alias("off"), "dst")
    none = spark.createDataFrame([(2, 0, True, 0)], "node long, flags int, collapsed boolean, stride long")
    got = specs.summary_spec(spark.createDataFrame([(1, 1)], "func long, node long"), none, links)
    assert {r[1:] for r in rows(got.na.fill(-1))} == {("link", i, 8, i + 1) for i in range(1, 12)} | {("collapse", 2, -1, -1)}


def test_simulation_by_components(spark):
    links = chains(spark).select(F.col("src").alias("node"), F.lit(0).cast("long").alias("off"), F.lit("t").alias("ftype"), "dst", F.lit(0).cast("long").alias("dst_off"))
    seeds = spark.createDataFrame([(1, 0, 101, 0), (2, 200, 200, 0)], "cs long, n1 long, n2 long, off long")
    sim, bad = simulate.simulate(seeds, links, links, max_rounds=3, small=50)
    assert rows(sim) == sorted([(1, i, 101 + i, 0) for i in range(12)] + [(2, 200 + i, 200 + i, 0) for i in range(13)])
    assert rows(bad) == [(1, 11, 112)]


def test_weighted_classes_by_components(spark):
    eq = chains(spark).select(F.col("src").alias("n1"), F.lit(4).cast("long").alias("o1"), F.col("dst").alias("n2"), F.lit(0).cast("long").alias("o2"))
    nodes = eq.select(F.col("n1").alias("node")).union(spark.createDataFrame([(5000,)], "node long"))
    want = [(100 * i + j, 100 * i, 4 * j, False) for i in range(12) for j in range(13)] + [(5000, 5000, 0, False)]
    assert rows(fixpoint.weighted_components(nodes, eq, max_rounds=2, small=50)) == sorted(want)


def test_cycles_are_condensed_within_ranges_first(spark, monkeypatch):
    """Many small cycles in a long chain: what is left of them fits one task, so that no search from pivots is needed."""
    monkeypatch.setattr(callgraph, "reach", None)
    funcs = spark.range(100).withColumnRenamed("id", "func")
    f, low = F.col("func"), F.col("func") - F.col("func") % 10
    calls = funcs.select(f.alias("caller"), (low + (f + 1) % 10).alias("callee")).union(funcs.filter("func >= 10").select("func", f - 10)).union(funcs.filter("func >= 10").select("func", low - 10))
    calls = calls.withColumn("cs", F.monotonically_increasing_id())
    found = callgraph.scc(funcs, calls, small=150)
    assert rows(found) == [(i, i - i % 10) for i in range(100)]
    assert {r.n_uses for r in callgraph.uses_and_defs(calls, found).filter("func < 10").collect()} == {30}
    assert rows(callgraph.merged_by_cycles(funcs.withColumn("scc", f), found)) == [(i, i - i % 10) for i in range(100) if i % 10]


def test_reach_writes_few_tables(spark, monkeypatch):
    """Components are found while rows are dealt to ranges: six tables are written, not one for each step."""
    cuts, cut = [], fixpoint.cut
    monkeypatch.setattr(fixpoint, "cut", lambda df: cuts.append(1) or cut(df))
    seeds = spark.createDataFrame([(7, 0), (7, 105), (8, 1100)], "tag long, id long")
    got = rows(fixpoint.reach(seeds, chains(spark).union(chains(spark)), max_rounds=3, small=50))
    assert got == sorted([(7, i) for i in range(13)] + [(7, 100 + i) for i in range(5, 13)] + [(8, 1100 + i) for i in range(13)])
    assert len(cuts) <= 6


def test_regions_by_one_closure(spark, monkeypatch):
    """What only the result reaches is found in the closure of the arguments, without a second one; large components likewise."""
    calls = []
    monkeypatch.setattr(shadow, "reach", lambda *a, **k: calls.append(1) or fixpoint.reach(*a, **k, small=small))
    arguments, returns = (spark.createDataFrame(x, "func long, node long") for x in ([(1, 6), (3, 100)], [(1, 3), (2, 110), (3, 1000), (3, 105)]))
    for small in (10, 50, 1000):
        got = shadow.regions(arguments, returns, chains(spark).withColumnRenamed("src", "node"))
        want = [(1, i, "in") for i in range(6, 13)] + [(1, i, "out") for i in range(3, 6)] + [(2, i, "out") for i in range(110, 113)]
        assert rows(got) == sorted(want + [(3, i, "in") for i in range(100, 113)] + [(3, i, "out") for i in range(1000, 1013)])
    assert len(calls) == 3


def test_summary_specs_say_each_thing_once_before_the_join(spark):
    """Repeated rows of nodes and links are made distinct before they meet the functions, not after."""
    nodes = spark.createDataFrame([(2, 1, True, 8), (2, 1, False, 8), (2, 2, None, 4)], "node long, flags int, collapsed boolean, stride long")
    links = spark.createDataFrame([(1, 8, 2), (1, 8, 2)], "node long, off long, dst long")
    got = specs.summary_spec(spark.createDataFrame([(1, 1)], "func long, node long"), nodes, links)
    top = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in top
    found = rows(got.na.fill(-1))
    assert len(found) == len(set(found)) and {x for x in found if x[1] in ("link", "collapse", "mk_seq")} == {(1, "link", 1, 8, 2), (1, "collapse", 2, -1, -1), (1, "mk_seq", 2, 8, -1), (1, "mk_seq", 2, 4, -1)}


def test_weighted_classes_do_not_hang_on_the_order_of_rows():
    """Classes with conflicts too; and long chains in any order."""
    rng = np.random.default_rng(1)
    a, b, w = rng.integers(0, 300, 400), rng.integers(0, 300, 400), rng.integers(0, 4, 400)
    one = fixpoint._weighted_labels(np.arange(300), a, b, w)
    mixed = rng.permutation(400)
    assert all((x == y).all() for x, y in zip(one, fixpoint._weighted_labels(np.arange(300), a[mixed], b[mixed], w[mixed])))
    n = rng.permutation(20_000)
    ids, rep, delta, bad = fixpoint._weighted_labels(ids_ := np.arange(20_001), n, n + 1, np.full(20_000, 3))
    assert (rep == 0).all() and (delta == 3 * ids_).all() and not bad.any()


def test_uses_count_a_site_once_for_each_component(spark):
    """Sites with several callees, and functions of no call; one table of calls is dealt out by site."""
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "func long, scc long")
    calls = spark.createDataFrame([(10, 1, 1), (10, 1, 2), (10, 1, 3), (11, 3, 2), (11, 3, 2), (12, 3, 9)], "cs long, caller long, callee long")
    got = callgraph.uses_and_defs(calls, comp)
    assert rows(got) == [(1, 2, 1), (2, 2, 1), (3, 1, 2), (4, 0, 0)]
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def test_merged_by_cycles_reads_the_calls_once(spark, monkeypatch):
    from cellgraph.plans import facts, more

    taken, get = [], facts.Facts.__getitem__
    monkeypatch.setattr(facts.Facts, "__getitem__", lambda self, name: taken.append(name) or get(self, name))
    assert more.graphs_merged_by_cycles(facts.Facts(spark, "/root/testdata/sf0.001")).columns == ["old", "new"]
    assert sorted(taken) == ["call", "func"]


def test_weighted_classes_within_ranges(spark, monkeypatch):
    """Pointers have lower ids than all objects: classes are solved where the objects are, only shared ones again; conflicts come out as in one task."""
    monkeypatch.setattr(fixpoint, "BIN", 100)
    monkeypatch.setattr(fixpoint, "by_component", None)
    rng = np.random.default_rng(4)
    body = np.repeat(np.arange(-30, 70), 6)
    x, y, o = body * 8 + rng.integers(0, 8, 600), (1000 + body + (rng.random(600) < 0.05)) * 16 + rng.integers(0, 16, 600), rng.integers(0, 2, 600) * 8
    none = [(7, None, 17000, 0), (None, 0, 17000, 0), (7, 0, None, 0)]
    eq = spark.createDataFrame([(a, c, b, 0) for a, b, c in zip(x.tolist(), y.tolist(), o.tolist())] + none, "n1 long, o1 long, n2 long, o2 long")
    nodes = spark.createDataFrame([(5,), (-900,), (99_999,), (None,)], "node long")
    want = list(zip(*(v.tolist() for v in fixpoint._weighted_labels(np.array([5, -900, 99_999]), x, y, o))))
    assert 10 < sum(r[3] for r in want) < len(want) - 10
    assert rows(fixpoint.weighted_components(nodes, eq, small=400)) == sorted(want)


def test_least_of_each_by_numbers_or_rows():
    """Large gaps do not fit one number with both ends: the same either way."""
    rng = np.random.default_rng(5)
    hi, lo, gap = rng.integers(0, 50, 300), rng.integers(0, 5, 300), rng.integers(-3, 3, 300)
    for scale in (1, 2**58):
        got = fixpoint._least_of_each(hi, lo, gap * scale, 50)
        want = {h: min((x, g) for k, x, g in zip(hi.tolist(), lo.tolist(), (gap * scale).tolist()) if k == h) for h in hi.tolist()}
        assert list(zip(*(v.tolist() for v in got))) == [(h, *want[h]) for h in sorted(want)]


def test_ids_in_two_ranges(spark):
    words = [(-1, -(2**63)), (-1, -(2**63) + 1), (3, 5), (3, 4), (3, 12), (4, 1)]
    assert rows(fixpoint._in_two_ranges(spark.createDataFrame(words, "word long, bits long"))) == [(-1,), (194,)]


def test_weighted_unify_of_rows_with_nulls(spark, sf, tmp_path):
    """A row with a null tells no equation, but what it names is a vertex."""
    from cellgraph.plans import catalog, facts

    line = spark.read.parquet(f"{sf}/lineitem.parquet").limit(200)
    for i, c in enumerate(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")):
        line = line.withColumn(c, F.when(F.col("l_quantity") % 8 != 2 * i, F.col(c)))
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = rows(catalog.queries()["weighted_unify"](spark, str(tmp_path)).select("node"))
    assert got == rows(facts.Facts(spark, str(tmp_path))["vertex"].dropna())


def test_calls_are_condensed_where_they_are_read(spark, monkeypatch):
    """Of ten groups that call all of their group, calls to and from the least are left, whatever is repeated; nulls call nothing."""
    sizes, cut = [], callgraph.cut
    monkeypatch.setattr(callgraph, "cut", lambda df: sizes.append((kept := cut(df)).count()) or kept)
    f, g = F.col("func"), F.floor(F.col("func") / 10) * 10
    funcs = spark.range(100).withColumnRenamed("id", "func").coalesce(1)
    calls = funcs.select(f.alias("caller"), F.explode(F.sequence(g, g + 9)).alias("callee")).union(funcs.filter("func >= 10").select(f, f - 10))
    calls = calls.unionAll(calls).coalesce(1).union(spark.createDataFrame([(None, 3), (3, None)], "caller long, callee long"))
    assert rows(callgraph.scc(funcs, calls)) == [(i, i - i % 10) for i in range(100)]
    assert sizes[0] <= 10 * 18 + 9


def test_components_of_calls_in_several_tasks(spark, monkeypatch):
    """Cycles across tasks and their slices, far ids, few slices or many: the same as by reachability."""
    monkeypatch.setattr(callgraph, "BIN", 7)
    rng = np.random.default_rng(6)
    for scale in (1, 2**55):
        pairs = [(int(a) * scale, int(b) * scale) for a, b in rng.integers(-30, 30, (75, 2))]
        nodes = sorted({n for p in pairs for n in p})
        sees = {n: {n} for n in nodes}
        while any(len(sees[a]) < len(new := sees[a] | sees[b]) and not sees.update({a: new}) for a, b in pairs):
            pass
        want = [(n, min(m for m in sees[n] if n in sees[m])) for n in nodes]
        assert any(a != b for a, b in want)
        got = callgraph.scc(spark.createDataFrame([(n,) for n in nodes], "func long"), spark.createDataFrame(pairs, "caller long, callee long").repartition(3))
        assert rows(got) == want
