"""The fixpoint of unification: classes, collapse and array state, congruence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FLAG
from .fixpoint import cut, weighted_components
from .graph import absorb_omni, congruence


@dataclass
class MemoryGraph:
    """node(node, flags, size, stride, collapsed), link, accessed, site, cell, and lab(id, node, off): where each input node went."""

    node: DataFrame
    link: DataFrame
    accessed: DataFrame
    site: DataFrame
    cell: DataFrame
    lab: DataFrame


def adjusted(off, collapsed, stride):
    return F.when(collapsed, F.lit(0).cast("long")).when(stride > 0, F.pmod(off, stride)).otherwise(off)


def _states(nodes: DataFrame, lab: DataFrame) -> DataFrame:
    """rep, flags, size, stride, collapsed: the order-free result of the unification table.

    Arrays of one class must have strides that the least one divides, at
    multiples of it; plain parts must fit inside one element unless they start
    it. Anything else collapses the class.
    """
    rows = nodes.join(lab, "node")
    low = rows.groupBy("rep").agg(F.min(F.when(F.col("stride") > 0, F.col("stride"))).alias("least"))
    rows = rows.join(low, "rep")
    least = F.col("least")
    array = F.col("stride") > 0
    misfit = F.when(array, (F.pmod("stride", least) != 0) | (F.pmod("delta", least) != 0)).otherwise((F.pmod("delta", least) != 0) & (F.pmod("delta", least) + F.col("size") > least))
    bad = F.col("conflict") | F.col("collapsed") | F.coalesce(misfit, F.lit(False))
    out = rows.groupBy("rep").agg(F.bit_or("flags").alias("flags"), F.max(F.col("delta") + F.col("size")).alias("plain"), F.first("least").alias("least"), F.bool_or(bad).alias("collapsed"))
    stride = F.when(F.col("collapsed"), F.lit(0)).otherwise(F.coalesce("least", F.lit(0))).cast("long")
    flags = F.when(F.col("collapsed"), F.col("flags").bitwiseAND(F.lit(~FLAG["array"]))).otherwise(F.col("flags"))
    return out.select(F.col("rep").alias("node"), flags.alias("flags"), F.when(F.col("collapsed"), F.lit(1).cast("long")).when(stride > 0, stride).otherwise(F.col("plain")).alias("size"), stride.alias("stride"), "collapsed")


def solve(facts: dict[str, DataFrame], extra_eq: DataFrame | None = None, max_rounds: int = 50) -> MemoryGraph:
    """Unify until no field has two targets and no state changes.

    ``facts`` are those of :func:`cellgraph.operators.local.facts`. Classes only
    merge and states only rise, so the loop ends; it raises after ``max_rounds``.
    """
    eq = facts["eq"].select("n1", "o1", "n2", "o2")
    eq = eq if extra_eq is None else eq.unionByName(extra_eq)
    eq, link, cell, site = cut(eq), cut(facts["link"].select("node", "off", "ftype", "dst", "dst_off")), cut(facts["cell"]), cut(facts["site"].select("node", "val"))
    accessed = cut(facts["accessed"].select("node", "off", "type", "bytes"))
    ids = [eq.select(F.col("n1").alias("node")), eq.select(F.col("n2").alias("node")), link.select("node"), link.select(F.col("dst").alias("node")), cell.select("node"), accessed.select("node"), facts["flag"].select("node"), facts["array"].select("node")]
    nodes = ids[0]
    for d in ids[1:]:
        nodes = nodes.union(d)
    nodes = nodes.distinct()
    flags = facts["flag"].groupBy("node").agg(F.bit_or("flags").alias("flags"))
    sizes = accessed.groupBy("node").agg(F.max(F.col("off") + F.col("bytes")).alias("size"))
    strides = facts["array"].groupBy("node").agg(F.min("stride").alias("stride"))
    gone = facts["collapse"].select("node").distinct().withColumn("collapsed", F.lit(True))
    nodes = nodes.join(flags, "node", "left").join(sizes, "node", "left").join(strides, "node", "left").join(gone, "node", "left")
    nodes = cut(nodes.select("node", F.coalesce("flags", F.lit(0)).alias("flags"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("stride", F.lit(0)).alias("stride"), F.coalesce("collapsed", F.lit(False)).alias("collapsed")))
    where = nodes.select(F.col("node").alias("id"), "node", F.lit(0).cast("long").alias("off"))
    for _ in range(max_rounds):
        lab = cut(weighted_components(nodes.select("node"), eq))
        nodes = cut(_states(nodes, lab))
        to = cut(lab.join(nodes.select(F.col("node").alias("rep"), "collapsed", "stride"), "rep").select("node", "rep", "delta", "collapsed", "stride"))

        def moved(df, col="node", off="off"):
            """(col, off) of a table at their class and adjusted offset."""
            j = df.join(to.withColumnRenamed("node", col), col)
            return j.withColumn(off, adjusted(F.col(off) + F.col("delta"), F.col("collapsed"), F.col("stride"))).drop(col, "delta", "collapsed", "stride").withColumnRenamed("rep", col)

        link = cut(absorb_omni(moved(moved(link), "dst", "dst_off").select("node", "off", "ftype", "dst", "dst_off")))
        accessed = cut(moved(accessed).select("node", "off", "type", "bytes").distinct())
        where = cut(moved(where).select("id", "node", "off"))
        # an access beyond an array's element collapses it
        over = accessed.join(nodes.filter("stride > 0").select("node", "stride"), "node").filter("off + bytes > stride").select("node").distinct()
        more = cut(congruence(link))
        grown = cut(over)
        if more.isEmpty() and grown.isEmpty():
            break
        nodes = cut(nodes.join(grown.withColumn("hit", F.lit(True)), "node", "left").select("node", "flags", "size", "stride", F.coalesce("hit", "collapsed").alias("collapsed")))
        eq = more
    else:
        raise RuntimeError(f"no fixpoint in {max_rounds} rounds")
    cell = cell.drop("off").join(where.select(F.col("id").alias("node"), F.col("node").alias("rep"), "off"), "node").select("graph", "kind", "val", F.col("rep").alias("node"), "off").distinct()
    site = site.join(where.select(F.col("id").alias("node"), F.col("node").alias("rep")), "node").select(F.col("rep").alias("node"), "val").distinct()
    return MemoryGraph(nodes, link.distinct(), accessed, site, cell, where)


def memory_only(m: MemoryGraph) -> DataFrame:
    """Nodes that are memory: those some pointer refers to, with flags, size and state."""
    used = m.cell.select("node").union(m.link.select(F.col("dst").alias("node"))).distinct()
    return m.node.join(used, "node", "left_semi")
