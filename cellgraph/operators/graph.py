"""Memory-graph algebra on relations.

Tables (all ids long): ``node(node, flags, size)``, ``link(node, off, ftype, dst,
dst_off)``, ``accessed(node, off, type)``, ``site(node, val)``, ``cell(kind, val,
node, off)``, ``lab(id, rep)`` or ``lab(node, rep, delta)`` from the fixpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FLAG, OMNI, join_flags
from .fixpoint import components, cut, reach


def offset_adjust(off: Column, collapsed: Column, is_array: Column, size: Column) -> Column:
    """The offset as a node sees it: 0 if collapsed, modulo the stride in an array, else unchanged."""
    return F.when(collapsed, F.lit(0).cast("long")).when(is_array & (size > 0), F.pmod(off, size)).otherwise(off)


def merged_nodes(nodes: DataFrame, lab: DataFrame) -> DataFrame:
    """Flags and size of each class: flags joined, size the largest."""
    collapsed = F.bool_or(F.col("collapsed")) if "collapsed" in nodes.columns else F.lit(False)
    return nodes.join(lab, nodes["node"] == lab["id"]).groupBy("rep").agg(join_flags(F.col("flags"), collapsed).alias("flags"), F.max("size").alias("size"))


def merged_sets(rows: DataFrame, lab: DataFrame, value: str) -> DataFrame:
    """Set-valued facts (alloc sites, accessed types) of each class: distinct (rep, value)."""
    return rows.join(lab, rows["node"] == lab["id"]).select("rep", value).distinct()


def congruence(links: DataFrame) -> DataFrame:
    """Equations from fields with several targets: the least target against each other one."""
    key = [c for c in ("node", "off", "ftype") if c in links.columns]
    target = F.struct("dst", "dst_off")
    least = links.groupBy(*key).agg(F.min(target).alias("first"), F.count_distinct("dst", "dst_off").alias("n")).filter("n > 1")
    pairs = links.join(least, key).filter(target != F.col("first"))
    return pairs.select(F.col("first.dst").alias("n1"), F.col("first.dst_off").alias("o1"), F.col("dst").alias("n2"), F.col("dst_off").alias("o2")).distinct()


def absorb_omni(links: DataFrame) -> DataFrame:
    """At an offset with an omni link every typed link becomes an omni link."""
    omni = F.max((F.col("ftype") == OMNI).cast("int")).over(Window.partitionBy("node", "off"))
    return links.withColumn("ftype", F.when(omni == 1, F.lit(OMNI)).otherwise(F.col("ftype"))).distinct()


def get_link(wanted: DataFrame, links: DataFrame) -> DataFrame:
    """Targets of (node, off, ftype): the exact link, else the omni link; nulls if there is neither."""
    exact = links.select("node", "off", "ftype", F.col("dst").alias("d1"), F.col("dst_off").alias("f1"))
    omni = links.filter(F.col("ftype") == OMNI).select("node", "off", F.col("dst").alias("d2"), F.col("dst_off").alias("f2"))
    out = wanted.join(exact, ["node", "off", "ftype"], "left").join(omni, ["node", "off"], "left")
    return out.select("node", "off", "ftype", F.coalesce("d1", "d2").alias("dst"), F.when(F.col("d1").isNotNull(), F.col("f1")).otherwise(F.col("f2")).alias("dst_off"))


def grow_size(accesses: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sizes after accesses (node, off, bytes); an array that would grow collapses to size 1."""
    need = accesses.groupBy("node").agg(F.max(F.col("off") + F.col("bytes")).alias("need"))
    out = nodes.join(need, "node", "left").withColumn("need", F.coalesce("need", F.lit(0)))
    is_array = F.col("flags").bitwiseAND(F.lit(FLAG["array"])) != 0
    collapsed = is_array & (F.col("need") > F.col("size"))
    return out.select("node", F.when(collapsed, F.lit(1).cast("long")).otherwise(F.greatest("size", "need")).alias("size"), collapsed.alias("collapsed"))


def collapse_offsets(links: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Links with all those of a collapsed node moved to offset 0."""
    hit = collapsed.select("node", F.lit(True).alias("hit"))
    return links.join(hit, "node", "left").withColumn("off", F.when(F.col("hit"), F.lit(0).cast("long")).otherwise(F.col("off"))).drop("hit").distinct()


def reachable_nodes(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(tag, id) of all nodes that links lead to from the roots (tag, id)."""
    return reach(roots, links.select(F.col("node").alias("src"), F.col("dst")))


def remove_dead(nodes: DataFrame, cells: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes that some cell reaches."""
    roots = cells.select(F.lit("live").alias("tag"), F.col("node").alias("id"))
    return nodes.join(reachable_nodes(roots, links).select(F.col("id").alias("node")), "node", "left_semi")


def remove_links(links: DataFrame, doomed: DataFrame) -> DataFrame:
    """Links that lead to none of the doomed nodes (node)."""
    return links.join(doomed.select(F.col("node").alias("dst")), "dst", "left_anti")


def remove_nodes(nodes: DataFrame, cells: DataFrame, links: DataFrame, doomed: DataFrame) -> DataFrame:
    """Nodes left when the doomed ones and then everything unreachable are gone."""
    gone = doomed.select("node").distinct()
    left = remove_links(links, gone).join(gone, "node", "left_anti")
    return remove_dead(nodes.join(gone, "node", "left_anti"), cells.join(gone, "node", "left_anti"), left)


def unique_scalars(cells: DataFrame) -> DataFrame:
    """Nodes that exactly one value points to at offset 0, with that value."""
    at = cells.groupBy("node").agg(F.count_distinct("val").alias("n"), F.min("val").alias("val"), F.max("off").alias("off"))
    return at.filter("n = 1 and off = 0").select("node", "val")


def merge_along(pairs: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alloc sites after merging both ways along the pairs (n1, n2): the class of each node, (node, rep), and the set of each class, (rep, val).

    A node's sites are those of its class; they are not repeated for each node.
    """
    lab = cut(components(pairs.select(F.col("n1").alias("a"), F.col("n2").alias("b"))))
    return lab.select(F.col("id").alias("node"), "rep"), merged_sets(sites, lab, "val")


def flat_memory(nodes: DataFrame, accessed: DataFrame) -> DataFrame:
    """The one node of flat memory: flags, number of types, largest size."""
    n = nodes.agg(F.bit_or("flags").alias("flags"), F.max("size").alias("size"), F.count(F.lit(1)).alias("merged"))
    t = accessed.agg(F.count_distinct("type").alias("types"))
    return n.withColumn("k", F.lit(0)).join(t.withColumn("k", F.lit(0)), "k").select(F.lit(0).cast("long").alias("node"), "flags", "size", "merged", "types")
