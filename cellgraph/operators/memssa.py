"""Memory regions, reaching definitions, clobbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def region_ids(nodes: DataFrame) -> DataFrame:
    """First region id of each node: nodes in order of first use take max(size, 1) ids each.

    Sizes are summed over blocks of first uses before the running sum, so that
    the single ordered window only sees one row for each block.
    """
    span = F.greatest("size", F.lit(1)).cast("long")
    rows = nodes.withColumn("span", span).withColumn("block", F.floor(F.col("first_use") / 4096))
    blocks = rows.groupBy("block").agg(F.sum("span").alias("s"))
    blocks = blocks.select("block", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("first_use", "node").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(blocks, "block").select("node", "span", (F.col("base") + F.coalesce(F.sum("span").over(inside), F.lit(0))).cast("long").alias("region"))


def reaching_definitions(accesses: DataFrame) -> DataFrame:
    """For each use in straight-line code the last definition of its region before it; 0: live on entry."""
    w = Window.partitionBy("func", "region").orderBy("acc").rowsBetween(Window.unboundedPreceding, -1)
    out = accesses.withColumn("reaching", F.coalesce(F.last(F.when(F.col("is_def"), F.col("acc")), ignorenulls=True).over(w), F.lit(0)).cast("long"))
    return out.filter("not is_def").select("func", "region", "acc", "reaching")


def may_clobber(pairs: DataFrame) -> DataFrame:
    """Whether a definition may clobber a use: (is_init, def_off, def_size, use_off, use_size, def_sites, use_sites)."""
    apart = (F.col("def_off") + F.col("def_size") <= F.col("use_off")) | (F.col("use_off") + F.col("use_size") <= F.col("def_off"))
    sites = F.col("def_sites").isNotNull() & F.col("use_sites").isNotNull() & ~F.arrays_overlap("def_sites", "use_sites")
    return pairs.withColumn("clobbers", F.when(F.col("is_init"), True).when(apart, False).when(sites, False).otherwise(True))


def solve_uses(uses: DataFrame, defs: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """Walk each use (use, at) up the chain of definitions (d, before, clobbers) to the first that may clobber it."""
    from .fixpoint import cut

    done, todo = None, cut(uses.select("use", "at"))
    for _ in range(max_rounds):
        if todo.isEmpty():
            return done
        step = cut(todo.join(defs, F.col("at") == F.col("d"), "left"))
        stop = step.filter("coalesce(clobbers, true) or before is null").select("use", F.col("at").alias("definition"))
        done = cut(stop if done is None else done.union(stop))
        todo = step.filter("not coalesce(clobbers, true) and before is not null").select("use", F.col("before").alias("at"))
        todo = cut(todo)
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def call_effects(calls: DataFrame, sim: DataFrame, nodes: DataFrame) -> DataFrame:
    """REF, MOD or NEW of each node that a call's callee touches, numbered by node within the call."""
    hit = calls.join(sim, "cs").join(nodes, "node").filter("is_read or is_modified")
    op = F.when(F.col("only_ret"), "NEW").when(F.col("is_modified"), "MOD").otherwise("REF")
    return hit.select("cs", "node", op.alias("op"), F.row_number().over(Window.partitionBy("cs").orderBy("node")).cast("long").alias("idx"))
