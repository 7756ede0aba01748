"""Shadow memory: operations on regions, in and out regions, control flow and memory SSA."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import reach

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What each intrinsic does to the region of its first argument.
INTRINSICS = {
    "calloc": "DEF", "memhavoc": "DEF", "free": "DEF", "reset_modified": "DEF", "reset_read": "DEF", "set_shadow": "DEF",
    "is_modified": "USE", "is_read": "USE", "is_alloc": "USE", "get_shadow": "USE",
}


def regions(arguments: DataFrame, returns: DataFrame, links: DataFrame) -> DataFrame:
    """func, node, side: 'in' for nodes that arguments or globals reach, 'out' for those that only the result reaches.

    ``arguments`` and ``returns`` are (func, node).
    """
    seed = lambda df: df.select(F.col("func").alias("tag"), F.col("node").alias("id"))
    found = reach(seed(arguments), links.select(F.col("node").alias("src"), "dst"), then=seed(returns))
    return found.select(F.col("tag").alias("func"), F.col("id").alias("node"), F.when(F.col("turn") == 0, "in").otherwise("out").alias("side"))


def operations(instructions: DataFrame, alloc_is_def: bool = False) -> DataFrame:
    """inst, seq, op, node, is_def of the instructions (inst, kind, name, node, src): one row for each access to a region.

    Kinds: load, store, alloca, alloc, memset, memcpy, intrinsic. A memcpy uses
    its source before it defines its target. Allocations use their region, or
    define it with ``alloc_is_def``; unknown intrinsics do nothing.
    """
    effect = F.create_map(*[F.lit(x) for kv in INTRINSICS.items() for x in kv])
    one = F.when(F.col("kind") == "load", "USE").when(F.col("kind").isin("store", "memset", "memcpy"), "DEF").when(F.col("kind").isin("alloca", "alloc"), "DEF" if alloc_is_def else "USE").when(F.col("kind") == "intrinsic", F.try_element_at(effect, "name"))
    main = instructions.select("inst", F.when(F.col("kind") == "memcpy", 2).otherwise(1).alias("seq"), F.when(F.col("kind") == "intrinsic", F.upper("name")).otherwise(F.upper("kind")).alias("op"), "node", one.alias("effect"))
    source = instructions.filter("kind = 'memcpy'").select("inst", F.lit(1).alias("seq"), F.lit("MEMCPY_SOURCE").alias("op"), F.col("src").alias("node"), F.lit("USE").alias("effect"))
    return main.union(source).filter("effect is not null and node is not null").select("inst", "seq", "op", "node", (F.col("effect") == "DEF").alias("is_def"))


def _dominators(entry: int, src: list, dst: list) -> list[tuple[int, int]]:
    """(dom, block) of one function: sets of dominators shrink until none changes; blocks that the entry does not reach have none."""
    into: dict[int, list[int]] = {}
    out: dict[int, list[int]] = {}
    for a, b in zip(src, dst):
        out.setdefault(a, []).append(b)
    order, todo, seen = [], [entry], {entry}
    while todo:
        a = todo.pop()
        order.append(a)
        for b in out.get(a, ()):
            into.setdefault(b, []).append(a)
            if b not in seen:
                seen.add(b)
                todo.append(b)
    bit = {b: 1 << i for i, b in enumerate(order)}
    every = (1 << len(order)) - 1
    dom = dict.fromkeys(order, every) | {entry: bit[entry]}
    changed = True
    while changed:
        changed = False
        for b in order[1:]:
            both = every
            for a in into[b]:
                both &= dom[a]
            both |= bit[b]
            changed |= both != dom[b]
            dom[b] = both
    return [(a, b) for b in order for a in order if dom[b] & bit[a]]


def dominated(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """func, dom, block: every path from the function's entry to the block runs through dom (itself included).

    ``edges`` is (func, src, dst), ``entries`` (func, block), one for each
    function. A function's control flow is one group: it is as large as the
    function, not as the program. Blocks that the entry does not reach have no row.
    """

    def run(key, table, starts):
        entry = starts.column("block")
        rows = _dominators(entry[0].as_py(), table.column("src").to_pylist(), table.column("dst").to_pylist()) if len(entry) else []
        return pa.table({"func": pa.array([key[0].as_py()] * len(rows), pa.int64()), "dom": pa.array([a for a, _ in rows], pa.int64()), "block": pa.array([b for _, b in rows], pa.int64())})

    return edges.groupBy("func").cogroup(entries.groupBy("func")).applyInArrow(run, "func long, dom long, block long")


def frontiers(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """func, block, front: blocks where the block's dominance ends: it dominates a predecessor of front, but not front itself strictly."""
    over = dom.select("func", F.col("dom").alias("block"), F.col("block").alias("src"))
    strict = dom.filter("dom <> block").select("func", F.col("dom").alias("block"), F.col("block").alias("front"))
    ends = edges.join(over, ["func", "src"]).select("func", "block", F.col("dst").alias("front")).distinct()
    return ends.join(strict, ["func", "block", "front"], "left_anti")


def phis(defs: DataFrame, front: DataFrame) -> DataFrame:
    """block, region of the phis: the iterated dominance frontier of the blocks that define a region (block, region)."""
    steps = front.select(F.col("block").alias("src"), F.col("front").alias("dst")).distinct()
    first = defs.select(F.col("region").alias("tag"), F.col("block").alias("src")).join(steps, "src").select("tag", F.col("dst").alias("id")).distinct()
    return reach(first, steps).select(F.col("id").alias("block"), F.col("tag").alias("region"))


def at_block_ends(defs: DataFrame, phi: DataFrame, dom: DataFrame) -> DataFrame:
    """block, region, version at the end of each block: its last definition, else its phi, else that of the nearest dominator. Where there is no row, the region is as on entry.

    ``defs`` is (block, region, acc), accesses numbered in order; a phi's
    version is the negative block id. ``dom`` is (func, dom, block).
    """
    last = defs.groupBy("block", "region").agg(F.max("acc").alias("version"))
    own = last.union(phi.join(last, ["block", "region"], "left_anti").select("block", "region", (-F.col("block")).alias("version")))
    depth = dom.groupBy("block").agg(F.count(F.lit(1)).alias("depth"))
    above = dom.select("block", "dom").join(depth.select(F.col("block").alias("dom"), "depth"), "dom")
    held = own.select(F.col("block").alias("dom"), "region", "version").join(above, "dom")
    return held.groupBy("block", "region").agg(F.max(F.struct("depth", "version")).alias("at")).select("block", "region", "at.version")


def phi_operands(phi: DataFrame, edges: DataFrame, ends: DataFrame) -> DataFrame:
    """block, region, pred, version: what each phi takes from each predecessor; 0 is live on entry."""
    into = phi.join(edges.select(F.col("dst").alias("block"), F.col("src").alias("pred")).distinct(), "block")
    return into.join(ends.select(F.col("block").alias("pred"), "region", "version"), ["pred", "region"], "left").select("block", "region", "pred", F.coalesce("version", F.lit(0)).alias("version"))


def versions(ops: DataFrame, by: str) -> DataFrame:
    """Accesses (inst, seq, op, node, is_def and ``by``, the straight-line code they are in) with ``version``: the definition made, and ``reaching``: the one before (0: live on entry)."""
    w = Window.partitionBy(by, "node").orderBy("inst", "seq").rowsBetween(Window.unboundedPreceding, -1)
    acc = F.col("inst") * 4 + F.col("seq")
    return ops.select(by, "inst", "seq", "op", "node", F.when(F.col("is_def"), acc).alias("version"), F.coalesce(F.last(F.when(F.col("is_def"), acc), ignorenulls=True).over(w), F.lit(0)).cast("long").alias("reaching"))


def live_on_exit(accesses: DataFrame, by: str) -> DataFrame:
    """The last version of each region at the end of the code (0: none)."""
    return accesses.groupBy(by, "node").agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def answers(instructions: DataFrame, accesses: DataFrame) -> DataFrame:
    """inst, op, node, version, reaching of the last access of any instructions; nulls where one touches no memory."""
    last = accesses.groupBy("inst").agg(F.max(F.struct("seq", "op", "node", "version", "reaching")).alias("a"))
    return instructions.select("inst").join(last, "inst", "left").select("inst", "a.op", "a.node", "a.version", "a.reaching")


def stripped(program: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of an instrumented program without those of the instrumentation."""
    return {k: v for k, v in program.items() if k not in ("mem_access", "mem_phi", "mem_region")}


def listing(accesses: DataFrame, by: str) -> DataFrame:
    """``by``, line: one text line for each access in order: ``3 = DEF STORE(n17, 2)`` or ``USE LOAD(n17, 3)``."""
    text = lambda c: F.col(c).cast("string")
    made = F.when(F.col("version").isNotNull(), F.concat(text("version"), F.lit(" = DEF "))).otherwise(F.lit("USE "))
    return accesses.select(by, "inst", "seq", F.concat(made, "op", F.lit("(n"), text("node"), F.lit(", "), text("reaching"), F.lit(")")).alias("line"))
