"""Allocation discovery, sizes of allocation sites, call paths."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import SMALL, appended, columns_of, cut, cut_folder, reach

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tasks that write out call paths, and steps of paths that one of them holds at once.
SHARES, STEPS = 16, 500_000

#: The names that allocate and release memory without being told so.
ALLOCATORS = ("malloc", "calloc", "realloc", "valloc", "memalign", "strdup", "_Znwm", "_Znam", "_Znwj", "_Znaj")
DEALLOCATORS = ("free", "cfree", "_ZdlPv", "_ZdaPv")


def seeds(functions: DataFrame, allocators: tuple[str, ...] = (), deallocators: tuple[str, ...] = ()) -> DataFrame:
    """func, role ('alloc' or 'dealloc') of functions (func, name) that are named as such, by default or on request."""
    role = F.when(F.col("name").isin(*ALLOCATORS, *allocators), "alloc").when(F.col("name").isin(*DEALLOCATORS, *deallocators), "dealloc")
    return functions.select("func", role.alias("role")).filter("role is not null")


def library_allocators(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Declared functions (func, is_decl, ret_noalias) that somebody calls and whose result is new memory."""
    return functions.filter("is_decl and ret_noalias").join(calls.select(F.col("callee").alias("func")), "func", "left_semi").select("func")


def sized(sites: DataFrame, types: DataFrame) -> DataFrame:
    """val, size of alloc sites (val, kind, type, count): the type's size times a constant count, or the constant size of a call; null if unknown.

    ``types`` is (type, bytes); ``count`` is null where it is no constant.
    """
    own = sites.join(types, "type", "left")
    size = F.when(F.col("kind") == "call", F.col("count")).when(F.col("kind") == "global", F.col("bytes")).otherwise(F.col("bytes") * F.col("count"))
    return own.select("val", size.cast("long").alias("size"))


def site_size(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """val, is_site, size of any values."""
    s = sizes.select("val", "size", F.lit(True).alias("hit"))
    return values.select("val").join(s, "val", "left").select("val", F.coalesce("hit", F.lit(False)).alias("is_site"), "size")


def copied(sites: DataFrame, strip: DataFrame) -> DataFrame:
    """Sites (node, val) that a clone takes along: not those of the stack (val)."""
    return sites.join(strip, "val", "left_anti")


def _paths(n: int, starts: list[int], out: dict[int, list[int]]):
    """Yields (func, path as codes of steps) of all paths that come up to each of the ``n`` functions once, depth first; a step's code is the function's place, or that plus ``n`` for a start."""
    for s in starts:
        path, on = [s + n], set()
        yield s, path
        work = [iter(out.get(s, ()))]
        while work:
            nxt = next((c for c in work[-1] if c not in on), None)
            if nxt is None:
                work.pop()
                on.discard(path.pop() % n)
                continue
            path.append(nxt)
            on.add(nxt)
            yield nxt, path
            work.append(iter(out.get(nxt, ())))


def call_paths(start: DataFrame, calls: DataFrame, kind: str = "BU", small: int = SMALL) -> DataFrame:
    """func, path: the steps by which a tracked site comes from its function (func) to its callers, each function once.

    ``calls`` is (callee, caller). Paths are as long as they are. Few calls
    (counted first) are walked depth first by some tasks, each of which writes
    out its share of the paths; many take a loop of joins.
    """
    first = cut(start.select("func").distinct())
    step = cut(calls.select("callee", "caller").filter("callee <> caller").distinct())
    if step.count() + first.count() > small:
        return _path_loop(first, step, kind)
    rows = first.select(F.col("func").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("kind")).union(step.select("callee", "caller", F.lit(1)))
    rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))

    def run(batches):
        t = columns_of(batches)
        if not t:
            return
        for share in np.unique(t["share"]).tolist():
            own = t["share"] == share
            edge = own & (t["kind"] == 1)
            ids, at = np.unique(np.concatenate([t["x"][own & (t["kind"] == 0)], t["x"][edge], t["y"][edge]]), return_inverse=True)
            k = len(at) - 2 * int(edge.sum())
            out: dict[int, list[int]] = {}
            for a, b in zip(at[k : k + edge.sum()].tolist(), at[k + edge.sum() :].tolist()):
                out.setdefault(a, []).append(b)
            names = pa.array([f"{kind}:{i}" for i in ids.tolist()] + [f"Local:{i}" for i in ids.tolist()])
            ends, codes, sizes = [], [], [0]
            held = 0
            flush = lambda: pa.RecordBatch.from_arrays([pa.array(ids[ends]), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), names.take(pa.array(np.concatenate(codes))))], ["func", "path"])
            for n, (end, path) in enumerate(_paths(len(ids), at[:k].tolist(), out)):
                if n % SHARES == share:
                    ends.append(end)
                    codes.append(np.array(path, np.int64))
                    sizes.append(len(path))
                    held += len(path)
                    if held > STEPS:
                        yield flush()
                        ends, codes, sizes, held = [], [], [0], 0
            if ends:
                yield flush()

    return rows.repartition(SHARES, "share").mapInArrow(run, "func long, path array<string>")


def _path_loop(first: DataFrame, step: DataFrame, kind: str) -> DataFrame:
    folder = cut_folder(first.sparkSession)
    at = cut(first.select("func", F.array(F.concat(F.lit("Local:"), F.col("func").cast("string"))).alias("path")))
    while True:  # ends: a path has each function once
        known = appended(at, folder)
        name = F.concat(F.lit(kind + ":"), F.col("caller").cast("string"))
        nxt = at.join(step, F.col("func") == F.col("callee")).filter(~F.array_contains("path", name))
        at = cut(nxt.select(F.col("caller").alias("func"), F.concat("path", F.array(name)).alias("path")))
        if at.isEmpty():
            return known


def unique_global_returns(returns: DataFrame, globals_: DataFrame) -> DataFrame:
    """func, val of functions that return one value only, a global: only its own site is passed on."""
    one = returns.groupBy("func").agg(F.count_distinct("val").alias("n"), F.min("val").alias("val")).filter("n = 1").select("func", "val")
    return one.join(globals_.select("val"), "val", "left_semi").select("func", "val")


def without_pointers(constants: DataFrame, leaves: DataFrame) -> DataFrame:
    """Constants (val, type) whose type has no pointer among its leaves: cloning stops there."""
    held = leaves.filter(F.col("leaf").endswith("*")).select("type").distinct()
    return constants.join(held, "type", "left_anti").select("val")


def walked_sites(values: DataFrame, sources: DataFrame) -> DataFrame:
    """val, site: the alloc sites that each value comes from through its sources (val, src); null where some source is unknown.

    ``values`` is (val, site, unknown): a value that is itself a site has one, a
    load or call result is unknown.
    """
    seeds_ = values.select(F.col("val").alias("tag"), F.col("val").alias("id"))
    at = reach(seeds_, sources.select(F.col("val").alias("src"), F.col("src").alias("dst")))
    found = at.join(values.select(F.col("val").alias("id"), "site", "unknown"), "id")
    poisoned = found.groupBy("tag").agg(F.bool_or("unknown").alias("bad"))
    known = found.filter("site is not null").join(poisoned.filter("not bad"), "tag").select(F.col("tag").alias("val"), "site").distinct()
    return known.union(poisoned.filter("bad").select("tag", F.lit(None).cast("long")))
