"""Simulation relations between two graphs: of a callee and its caller, or of one function before and after."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import SMALL, appended, components, cut, cut_folder, in_parts, split_by_component

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def not_functions(sim: DataFrame) -> DataFrame:
    """(cs, n1) with more than one image: there the relation is no function."""
    return sim.groupBy("cs", "n1").agg(F.count_distinct("n2", "off").alias("images")).filter("images > 1")


def not_injective(sim: DataFrame, modified: DataFrame) -> DataFrame:
    """(cs, n2, off) that several nodes map to, for modified targets only."""
    hit = sim.groupBy("cs", "n2", "off").agg(F.count_distinct("n1").alias("sources")).filter("sources > 1")
    return hit.join(modified.select(F.col("node").alias("n2")), "n2", "left_semi").select("cs", "n2", "off", "sources")


def images(wanted: DataFrame, sim: DataFrame) -> DataFrame:
    """cs, n1, n2, off: the one image of each wanted node (cs, n1); nulls where there is none or more than one."""
    one = sim.groupBy("cs", "n1").agg(F.count_distinct("n2", "off").alias("n"), F.min(F.struct("n2", "off")).alias("at")).filter("n = 1")
    return wanted.select("cs", "n1").join(one, ["cs", "n1"], "left").select("cs", "n1", "at.n2", "at.off")


def seeds_of_cells(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds (cs, n1, n2, off) from cells (cs, key, node, off) of two graphs that stand for the same thing, and the violations (cs, key).

    It is a violation if only one of the two is null, or if the target's offset
    is smaller than the source's and the target is no array (column ``is_array``
    of ``right``).
    """
    a = left.select("cs", "key", F.col("node").alias("n1"), F.col("off").alias("f1"))
    b = right.select("cs", "key", F.col("node").alias("n2"), F.col("off").alias("f2"), "is_array")
    j = a.join(b, ["cs", "key"])
    bad = F.col("n1").isNull() != F.col("n2").isNull()
    bad = bad | ((F.col("f2") < F.col("f1")) & ~F.coalesce("is_array", F.lit(False)))
    ok = j.filter(~F.coalesce(bad, F.lit(False)) & F.col("n1").isNotNull())
    return ok.select("cs", "n1", "n2", F.greatest(F.col("f2") - F.col("f1"), F.lit(0).cast("long")).alias("off")).distinct(), j.filter(F.coalesce(bad, F.lit(False))).select("cs", "key").distinct()


def state_violations(sim: DataFrame, nodes1: DataFrame, nodes2: DataFrame) -> DataFrame:
    """(cs, n1, n2) whose states do not fit: a collapsed or array node mapped to one that is not, an array at an offset, or elements that do not divide."""
    a = nodes1.select(F.col("node").alias("n1"), F.col("collapsed").alias("c1"), F.col("stride").alias("s1"))
    b = nodes2.select(F.col("node").alias("n2"), F.col("collapsed").alias("c2"), F.col("stride").alias("s2"))
    j = sim.join(a, "n1").join(b, "n2")
    open_ = ~F.col("c2")
    bad = open_ & (F.col("c1") | ((F.col("s1") > 0) & ((F.col("s2") <= 0) | (F.col("off") % F.greatest("s2", F.lit(1)) != 0) | (F.col("s1") % F.greatest("s2", F.lit(1)) != 0))))
    return j.filter(bad).select("cs", "n1", "n2").distinct()


def _step(fresh: DataFrame, l1: DataFrame, l2: DataFrame) -> DataFrame:
    return fresh.join(l1, "n1").join(l2, (F.col("n2") == F.col("m2")) & (F.col("f") + F.col("off") == F.col("g")) & (F.col("ftype") == F.col("t2")), "left")


def simulate(seeds: DataFrame, links1: DataFrame, links2: DataFrame, max_rounds: int = 10_000, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Closure of (cs, n1, n2, off) along equal fields, and the violations (cs, n1, n2) where a field has no image.

    Where seeds and links are few (counted first), one task closes all. For more
    of them, nodes that seeds or links tie to each other are a component, many
    tasks close some components each, and only components that are too large
    for a task take a loop of joins, each round of which appends what is new.
    """
    l1 = cut(links1.select(F.col("node").alias("n1"), F.col("off").alias("f"), "ftype", F.col("dst").alias("d1"), F.col("dst_off").alias("x1")))
    l2 = cut(links2.select(F.col("node").alias("m2"), F.col("off").alias("g"), F.col("ftype").alias("t2"), F.col("dst").alias("d2"), F.col("dst_off").alias("x2")))
    fresh = cut(seeds.select("cs", "n1", "n2", "off").distinct())
    none = F.lit(None).cast("string")
    rows = fresh.select(F.lit(0).alias("kind"), F.col("cs").alias("a"), F.col("n1").alias("b"), F.col("n2").alias("c"), F.col("off").alias("d"), none.alias("s"), F.col("n1").alias("node"))
    rows = rows.union(l1.select(F.lit(1), "n1", "f", "d1", "x1", "ftype", "n1")).union(l2.filter("t2 is not null").select(F.lit(2), "m2", "g", "d2", "x2", "t2", "m2"))
    schema = "bad boolean, cs long, n1 long, n2 long, off long"
    rest = None
    if fresh.count() + l1.count() + l2.count() <= small:
        found = in_parts(rows.drop("node"), _close, schema)
    else:
        ties = fresh.select(F.col("n1").alias("a"), F.col("n2").alias("b")).union(l1.select("n1", "d1")).union(l2.select("m2", "d2"))
        fit, rest = split_by_component(rows, cut(components(ties, small=small)), small)
        found = in_parts(fit.drop("node"), _close, schema, "rep", 100_000)
    found = cut(found)
    sim, bad = found.filter("not bad").select("cs", "n1", "n2", "off"), found.filter("bad").select("cs", "n1", "n2")
    if rest is not None:
        of = lambda k, *names: cut(rest.filter(F.col("kind") == k).select(*[F.col(c).alias(n) for c, n in zip("abcds", names)]))
        more, worse = _simulate_loop(of(0, "cs", "n1", "n2", "off"), of(1, "n1", "f", "d1", "x1", "ftype"), of(2, "m2", "g", "d2", "x2", "t2"), max_rounds)
        sim, bad = sim.union(more), bad.union(worse)
    return sim, bad.distinct()


def _simulate_loop(fresh: DataFrame, l1: DataFrame, l2: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    spark = fresh.sparkSession
    folder, bad_folder = cut_folder(spark), cut_folder(spark)
    known = appended(fresh, folder)
    bad = appended(fresh.select("cs", "n1", "n2").filter("false"), bad_folder)
    for _ in range(max_rounds):
        step = cut(_step(fresh, l1, l2))
        bad = appended(step.filter("d2 is null or x2 < x1").select("cs", "n1", "n2").distinct(), bad_folder)
        new = step.filter("d2 is not null and x2 >= x1").select("cs", F.col("d1").alias("n1"), F.col("d2").alias("n2"), (F.col("x2") - F.col("x1")).alias("off")).distinct()
        fresh = cut(new.join(known, ["cs", "n1", "n2", "off"], "left_anti"))
        if fresh.isEmpty():
            return known, bad.distinct()
        known = appended(fresh, folder)
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def _close(batches):
    """The closure over all rows of some tasks' components, breadth first."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    kind = table.column("kind").to_numpy()
    columns = lambda k, names: [table.column(x).filter(pa.array(kind == k)).to_pylist() for x in names]
    right: dict[tuple, list] = {}
    for m2, g, d2, x2, t in zip(*columns(2, "abcds")):
        right.setdefault((m2, g, t), []).append((d2, x2))
    left: dict[int, list] = {}
    for n1, *field in zip(*columns(1, "abcds")):
        left.setdefault(n1, []).append(field)
    known = set(zip(*columns(0, "abcd")))
    todo, bad = list(known), set()
    while todo:
        cs, n1, n2, off = todo.pop()
        for f, d1, x1, t in left.get(n1, ()):
            targets = right.get((n2, f + off, t), ())
            if not targets:
                bad.add((cs, n1, n2))
            for d2, x2 in targets:
                if x2 < x1:
                    bad.add((cs, n1, n2))
                elif (new := (cs, d1, d2, x2 - x1)) not in known:
                    known.add(new)
                    todo.append(new)
    for flag, found in ((False, known), (True, [(*k, 0) for k in bad])):
        if found:
            values = [pa.array(x, pa.int64()) for x in zip(*found)]
            yield pa.RecordBatch.from_arrays([pa.array([flag] * len(found)), *values], ["bad", "cs", "n1", "n2", "off"])
