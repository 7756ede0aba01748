"""Call graphs: strongly connected components, levels, resolution, statistics."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import BIN, FEW, columns_of, cut, in_parts, ranked, reach

cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Call graphs of at most so many functions and different edges (counted first) are searched in one task, which takes some 60 bytes for each.
ONE_TASK = 10_000_000


def _tarjan(funcs: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """func, least member of its component, level (longest chain of components below), by one depth-first search."""
    nodes = np.unique(np.concatenate([funcs, src, dst]))
    s, d = np.searchsorted(nodes, src).astype(np.int32), np.searchsorted(nodes, dst).astype(np.int32)
    order = np.argsort(s, kind="stable")
    out = memoryview(d[order])
    first = np.searchsorted(s[order], np.arange(len(nodes) + 1), "left").tolist()
    index, low, comp = [-1] * len(nodes), [0] * len(nodes), [-1] * len(nodes)
    level: list[int] = []
    least: list[int] = []
    stack: list[int] = []
    count = 0
    for root in range(len(nodes)):
        if index[root] >= 0:
            continue
        work = [(root, first[root])]
        while work:
            v, i = work.pop()
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
            elif i > first[v] and comp[out[i - 1]] < 0:
                low[v] = min(low[v], low[out[i - 1]])
            for j in range(i, first[v + 1]):
                w = out[j]
                if index[w] < 0:
                    work += [(v, j + 1), (w, first[w])]
                    break
                if comp[w] < 0:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    members = []
                    while not members or members[-1] != v:
                        members.append(stack.pop())
                        comp[members[-1]] = len(level)
                    below = [level[comp[w]] + 1 for m in members for w in out[first[m] : first[m + 1]] if comp[w] != len(level)]
                    level.append(max(below, default=0))
                    least.append(min(members))
    c = np.array(comp, np.int64)[np.searchsorted(nodes, funcs)]
    return funcs, nodes[np.array(least, np.int64)[c]], np.array(level, np.int64)[c]


def _different(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different edges, by source."""
    if not len(src):
        return src, dst
    low, wide = dst.min(), int(dst.max()) - int(dst.min()) + 1
    base = src.min()
    if (int(src.max()) - int(base) + 1) * wide < 2**63:
        at = np.sort((src - base) * wide + (dst - low))  # np.unique hashes, which is slower
        at = at[np.append(True, at[1:] != at[:-1])]
        up = at // wide
        return up + base, at - up * wide + low
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    fresh = np.append(True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]))
    return src[fresh], dst[fresh]


def _condense_batches(batches):
    t = columns_of(batches)
    if t:
        edge = t["kind"] == 1
        found = _tarjan(t["x"][~edge], *_different(t["x"][edge], t["y"][edge]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["func", "scc", "level"])


def _condensed(functions: DataFrame, edges: DataFrame, key: str | None = None) -> DataFrame:
    """func, scc, level in one task, or within each range of functions by itself."""
    rows = functions.select(F.col("func").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("kind")).union(edges.select("caller", "callee", F.lit(1)))
    schema = "func long, scc long, level long"
    if key is None:
        return in_parts(rows, _condense_batches, schema)
    return rows.repartitionByRange(max(2, -(-rows.count() // BIN)), key).mapInArrow(_condense_batches, schema)


def _fewer_calls(batches):
    """Calls with the same components as those of this task: each once; those in cycles found here are replaced by calls to and from the cycle's least function, which takes over all others."""
    held, more, n = (np.empty(0, np.int64),) * 2, [], 0

    def out(src, dst):
        for i in range(0, len(src), BIN):
            a, b = src[i : i + BIN], dst[i : i + BIN]
            funcs, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            top = _tarjan(funcs, a, b)[1]
            s, d = top[at[: len(a)]], top[at[len(a) :]]
            low = funcs != top
            s, d = np.concatenate([s, funcs[low], top[low]]), np.concatenate([d, top[low], funcs[low]])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _different(s[s != d], d[s != d])], ["caller", "callee"])

    for b in batches:
        more.append([b.column(c).to_numpy() for c in ("caller", "callee")])
        n += b.num_rows
        if n >= 2 * BIN:
            held, more, n = _different(*map(np.concatenate, zip(held, *more))), [], 0
            if len(held[0]) > 4 * BIN:
                yield from out(*held)
                held = held[0][:0], held[1][:0]
    yield from out(*_different(*map(np.concatenate, zip(held, *more))))


def scc(functions: DataFrame, calls: DataFrame, small: int = ONE_TASK) -> DataFrame:
    """func, scc (its smallest member): who reaches each other is one component.

    Cycles are condensed where the calls are read, before any shuffle. What is
    left, if small (counted), is searched in one task. Larger graphs are next
    condensed within ranges of functions; if what is left is still large:
    forward-backward search from the least function of every weakly closed part
    left: each round settles one component in each part and splits the rest.
    """
    edges = cut(calls.select(F.col("caller").cast("long"), F.col("callee").cast("long")).dropna().mapInArrow(_fewer_calls, "caller long, callee long"))
    n = functions.count()
    if edges.count() + n > small:
        edges = cut(edges.distinct())
    if edges.count() + n <= small:
        return _condensed(functions, edges).select("func", "scc")
    funcs = cut(functions.select("func").union(edges.select("caller")).union(edges.select("callee")).distinct())
    local = cut(_condensed(funcs, edges, "x").select("func", "scc"))
    src, dst = local.select(F.col("func").alias("caller"), F.col("scc").alias("s")), local.select(F.col("func").alias("callee"), F.col("scc").alias("d"))
    left = cut(edges.join(src, "caller").join(dst, "callee").filter("s <> d").select(F.col("s").alias("caller"), F.col("d").alias("callee")).distinct())
    reps = cut(local.select(F.col("scc").alias("func")).distinct())
    whole = _condensed(reps, left).select("func", "scc") if left.count() + reps.count() <= small else _forward_backward(reps, left)
    return local.join(functions, "func", "left_semi").join(whole.select(F.col("func").alias("scc"), F.col("scc").alias("top")), "scc").select("func", F.col("top").alias("scc"))


def _forward_backward(functions: DataFrame, edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    todo = cut(functions.select(F.col("func"), F.lit(0).cast("long").alias("part")))
    done = None
    while not todo.isEmpty():
        side = todo.select(F.col("func").alias("f"), "part")
        fwd = edges.join(side, F.col("caller") == F.col("f")).select("caller", "callee", F.col("part").alias("p")).join(side, F.col("callee") == F.col("f")).filter("p = part").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
        bwd = back.join(side, F.col("src") == F.col("f")).select("src", "dst", F.col("part").alias("p")).join(side, F.col("dst") == F.col("f")).filter("p = part").select("src", "dst")
        seeds = todo.groupBy("part").agg(F.min("func").alias("id")).select(F.col("part").alias("tag"), "id")
        f = cut(reach(seeds, cut(fwd))).select(F.col("id").alias("func"), F.lit(1).alias("f"))
        b = cut(reach(seeds, cut(bwd))).select(F.col("id").alias("func"), F.lit(1).alias("b"))
        split = todo.join(f, "func", "left").join(b, "func", "left").join(seeds.select(F.col("tag").alias("part"), F.col("id").alias("pivot")), "part")
        settled = split.filter("f = 1 and b = 1").select("func", F.col("pivot").alias("scc"))
        done = cut(settled if done is None else done.union(settled))
        rest = split.filter("not (coalesce(f, 0) = 1 and coalesce(b, 0) = 1)")
        todo = cut(rest.select("func", F.xxhash64("part", "pivot", F.coalesce("f", F.lit(0)), F.coalesce("b", F.lit(0))).alias("part")))
    return done if done is not None else functions.select("func", F.col("func").alias("scc"))


def levels(functions: DataFrame, calls: DataFrame, components: DataFrame, max_rounds: int = 100_000, small: int = ONE_TASK) -> DataFrame:
    """func, scc, level: longest chain of calls below, in the condensation (leaves are 0)."""
    calls = cut(calls.select("caller", "callee").distinct())
    if calls.count() + functions.count() <= small:
        return _condensed(functions, calls)
    src = components.select(F.col("func").alias("caller"), F.col("scc").alias("s"))
    dst = components.select(F.col("func").alias("callee"), F.col("scc").alias("d"))
    edges = cut(calls.join(src, "caller").join(dst, "callee").filter("s <> d").select("s", "d").distinct())
    level = cut(components.select("scc").distinct().withColumn("level", F.lit(0).cast("long")))
    for _ in range(max_rounds):
        up = edges.join(level, F.col("d") == F.col("scc")).groupBy(F.col("s").alias("scc")).agg((F.max("level") + 1).alias("up"))
        new = cut(level.join(up, "scc", "left").select("scc", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"), (F.coalesce("up", F.lit(0)) > F.col("level")).alias("moved")))
        level = new.select("scc", "level")
        if new.filter("moved").isEmpty():
            return components.join(level, "scc").select("func", "scc", "level")
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def resolve_indirect(sites: DataFrame, points_to: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges (cs, caller, callee) of indirect call sites: functions that their cell's node holds and whose signature fits."""
    found = sites.join(points_to, "node").join(functions, "callee").filter(F.col("signature") == F.col("callee_signature"))
    return found.select("cs", "caller", "callee").distinct()


def unresolved(sites: DataFrame, found: DataFrame, external: DataFrame) -> DataFrame:
    """Indirect call sites that keep their placeholder edge: without a callee found, or called through an external node (node)."""
    open_ended = sites.join(external, "node", "left_semi")
    done = found.select("cs").distinct().join(open_ended.select("cs"), "cs", "left_anti")
    return sites.join(done, "cs", "left_anti")


def statistics(calls: DataFrame) -> DataFrame:
    """Counts over call sites (cs, is_asm, direct, resolved)."""
    return calls.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("direct") & ~F.col("is_asm")).alias("direct"), F.count_if("is_asm").alias("asm"),
        F.count_if(~F.col("direct") & ~F.col("is_asm") & F.col("resolved")).alias("indirect_resolved"), F.count_if(~F.col("direct") & ~F.col("is_asm") & ~F.col("resolved")).alias("indirect_unresolved"),
    )


def uses_and_defs(calls: DataFrame, components: DataFrame) -> DataFrame:
    """func, n_uses, n_defs: call sites where it or a member of its component is callee or caller."""
    by = cut(components.select("func", "scc"))
    few = F.broadcast if by.count() <= FEW else lambda df: df
    at = calls.join(few(by.select(F.col("func").alias("callee"), F.col("scc").alias("u"))), "callee", "left").join(few(by.select(F.col("func").alias("caller"), F.col("scc").alias("d"))), "caller", "left")
    # all rows of a call site come to one task, which counts it once for each component
    parts = in_parts(at.select("cs", "u", "d", F.col("cs").alias("key")), _site_counts, "scc long, u long, d long", "key", 2 * BIN, calls.count())
    n = parts.groupBy("scc").agg(F.sum("u").alias("u"), F.sum("d").alias("d"))
    out = by.join(few(n), "scc", "left")
    return out.select("func", F.coalesce("u", F.lit(0)).alias("n_uses"), F.coalesce("d", F.lit(0)).alias("n_defs"))


def _site_counts(batches):
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    for i, side in enumerate(("u", "d")):
        pairs = t.filter(pc.and_(t.column("cs").is_valid(), t.column(side).is_valid()))
        c, k = pairs.column(side).to_numpy(), pairs.column("cs").to_numpy()
        order = np.lexsort((c, k))
        c, k = c[order], k[order]
        fresh = np.ones(len(c), bool)
        fresh[1:] = (c[1:] != c[:-1]) | (k[1:] != k[:-1])
        scc, n = np.unique(c[fresh], return_counts=True)
        none = np.zeros(len(n), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (scc, none if i else n, n if i else none)], ["scc", "u", "d"])


def positional(actuals: DataFrame, formals: DataFrame, calls: DataFrame, pointers: bool = False) -> DataFrame:
    """Equations (a, b) between actual and formal values by position.

    With ``pointers`` both tables have ``is_ptr``, and the n-th pointer argument
    meets the n-th pointer parameter, whatever stands between them.
    """
    if pointers:
        nth = lambda df, by: df.filter("is_ptr").withColumn("idx", F.row_number().over(Window.partitionBy(by).orderBy("idx")))
        actuals, formals = nth(actuals, "cs"), nth(formals, "func")
    a = calls.join(actuals, "cs").select("callee", "idx", F.col("val").alias("a"))
    return a.join(formals.select(F.col("func").alias("callee"), "idx", F.col("val").alias("b")), ["callee", "idx"]).select("a", "b").distinct()


def mod_ref(own: DataFrame, calls: DataFrame) -> DataFrame:
    """(func, region, op) with the effects of all functions called, own ones included."""
    back = calls.select(F.col("callee").alias("src"), F.col("caller").alias("dst")).distinct()
    seeds = own.select(F.struct("region", "op").alias("tag"), F.col("func").alias("id"))
    return reach(seeds, back).select(F.col("id").alias("func"), "tag.region", "tag.op")


def alloc_wrappers(seeds: DataFrame, calls: DataFrame) -> DataFrame:
    """Allocators and their wrappers: who returns a call's pointer without storing it, when the callee is one.

    ``calls`` has caller, callee, returned, stored.
    """
    passes = calls.filter("returned and not stored").select(F.col("callee").alias("src"), F.col("caller").alias("dst")).distinct()
    return reach(seeds.select(F.lit("alloc").alias("tag"), F.col("func").alias("id")), passes).select(F.col("id").alias("func"))


def stripped_callees(calls: DataFrame, casts: DataFrame) -> DataFrame:
    """Calls (cs, callee, called_val) with callees that casts (dst, src) hide: the function at the end of the chain of casts.

    ``casts`` lead from a value to the value or function that was cast.
    """
    ends = casts.join(casts.select(F.col("dst").alias("src")), "src", "left_anti").select(F.col("src").alias("id")).distinct()
    at = reach(calls.filter("callee is null").select(F.col("called_val").alias("tag"), F.col("called_val").alias("id")), casts.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = at.join(ends, "id").select(F.col("tag").alias("called_val"), F.col("id").alias("end"))
    return calls.join(found, "called_val", "left").select("cs", F.coalesce("callee", "end").alias("callee"), "called_val")


def cloned_sites(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """Call sites that callers get from their callees' graphs: (caller, cs, via, cloned), the callee's own ones marked as cloned.

    ``calls`` is (caller, callee); ``sites`` is (caller, cs) of unresolved calls.
    """
    own = sites.select("caller", "cs", F.col("caller").alias("via"), F.lit(False).alias("cloned"))
    up = calls.select("caller", "callee").distinct().filter("caller <> callee").join(sites.select(F.col("caller").alias("callee"), "cs"), "callee")
    return own.union(up.select("caller", "cs", F.col("callee").alias("via"), F.lit(True).alias("cloned"))).distinct()


def merged_by_cycles(before: DataFrame, after: DataFrame) -> DataFrame:
    """(old, new) of graphs whose components (func, scc) new edges have joined: each old graph is imported into the new one."""
    j = before.select("func", F.col("scc").alias("old")).join(after.select("func", F.col("scc").alias("new")), "func")
    return j.select("old", "new").distinct().filter("old <> new")


def completeness(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """cs, is_complete, n_callees: whether all callees of a call site are known (direct, asm, or resolved and not open), and how many there are.

    ``calls`` is (cs, direct, is_asm), ``edges`` (cs, callee).
    """
    n = edges.groupBy("cs").agg(F.count_distinct("callee").alias("n"))
    out = calls.select("cs", "direct", "is_asm").join(n, "cs", "left")
    return out.select("cs", (F.col("direct") | F.col("is_asm") | F.col("n").isNotNull()).alias("is_complete"), F.coalesce("n", F.lit(0)).alias("n_callees"))


def listing(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """cs, callees of each indirect call that was resolved, by name order."""
    return calls.filter("not direct").join(edges, "cs").groupBy("cs").agg(F.array_join(F.transform(F.sort_array(F.collect_set("callee")), lambda c: c.cast("string")), ",").alias("callees"))


def ordered_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges in order of the caller's and callee's names: (place, caller, callee)."""
    a, b = functions.select(F.col("func").alias("caller"), F.col("name").alias("x")), functions.select(F.col("func").alias("callee"), F.col("name").alias("y"))
    rows = calls.select("caller", "callee").distinct().join(a, "caller").join(b, "callee")
    return ranked(rows, "x", "y", "caller", "callee", name="place").select("place", "caller", "callee")


def with_specs(calls: DataFrame, specs: DataFrame, functions: DataFrame) -> DataFrame:
    """cs, callee: the call site of each edge, its callee replaced by the function that specifies it; ``specs`` is (name, spec)."""
    named = functions.select(F.col("func").alias("callee"), "name").join(specs, "name").select("callee", "spec")
    return calls.join(named, "callee", "left").select("cs", F.coalesce("spec", "callee").alias("callee"))


def frontier(changed: DataFrame, calls: DataFrame) -> DataFrame:
    """Call sites to look at again once functions (func) changed: those that call them or are in them, each once."""
    return calls.join(changed.select(F.col("func").alias("callee")), "callee", "left_semi").select("cs").union(calls.join(changed.select(F.col("func").alias("caller")), "caller", "left_semi").select("cs")).distinct()
