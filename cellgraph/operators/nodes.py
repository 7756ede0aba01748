"""Cells, links, types and scalars of memory nodes: lookups, updates, imports.

Tables as in :mod:`cellgraph.operators.graph`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ANY_TYPE
from .fixpoint import components, cut

LINK = ("node", "off", "ftype", "dst", "dst_off")


def set_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links with those of ``new`` in place of the ones at the same (node, off, ftype)."""
    return links.select(*LINK).join(new, ["node", "off", "ftype"], "left_anti").union(new.select(*LINK))


def collapse_nodes(nodes: DataFrame, scalars: DataFrame, collapsed: DataFrame) -> DataFrame:
    """node, size, scalar after collapsing: a collapsed node has size 1 and no unique scalar."""
    hit = nodes.join(scalars.select("node", F.col("val").alias("scalar")), "node", "left").join(collapsed.select("node", F.lit(True).alias("hit")), "node", "left")
    return hit.select("node", F.when(F.col("hit"), F.lit(1).cast("long")).otherwise(F.col("size")).alias("size"), F.when(F.col("hit").isNull(), F.col("scalar")).alias("scalar"))


def collapse_types(links: DataFrame) -> DataFrame:
    """Links without field types: all of an offset are one field."""
    return links.withColumn("ftype", F.lit(ANY_TYPE)).select(*LINK).distinct()


def flattened(accesses: DataFrame, leaves: DataFrame) -> DataFrame:
    """Accessed types (node, off, type) with aggregates replaced by their leaves (type, off, leaf), each at its own offset."""
    parts = leaves.select("type", F.col("off").alias("inner"), "leaf")
    out = accesses.join(parts, "type", "left")
    return out.select("node", (F.col("off") + F.coalesce("inner", F.lit(0))).alias("off"), F.coalesce("leaf", "type").alias("type")).distinct()


def joined_types(accessed: DataFrame, lab: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Accessed types of each class at their offsets in it; collapsed nodes, and classes with one, take and give none.

    ``lab`` is (node, rep, delta), ``collapsed`` (node).
    """
    gone = lab.join(collapsed, "node", "left_semi").select("rep").distinct()
    rows = accessed.join(lab, "node").join(gone, "rep", "left_anti")
    return rows.select("rep", (F.col("off") + F.col("delta")).alias("off"), "type").distinct()


def type_tests(nodes: DataFrame, accessed: DataFrame, off: int) -> DataFrame:
    """node, has_type (at the offset), is_void (no type anywhere)."""
    at = accessed.groupBy("node").agg(F.bool_or(F.col("off") == off).alias("has"))
    return nodes.select("node").join(at, "node", "left").select("node", F.coalesce("has", F.lit(False)).alias("has_type"), F.col("has").isNull().alias("is_void"))


def reconciled_scalars(scalars: DataFrame, pairs: DataFrame) -> DataFrame:
    """Unique scalars (node, val) after agreeing along the pairs (n1, n2): a class keeps one only if all its nodes have the same."""
    lab = cut(components(pairs.select(F.col("n1").alias("a"), F.col("n2").alias("b"))))
    rows = lab.join(scalars.select(F.col("node").alias("id"), "val"), "id", "left")
    same = rows.groupBy("rep").agg(F.min("val").alias("val"), ((F.count("val") == F.count(F.lit(1))) & (F.min("val") == F.max("val"))).alias("same")).filter("same")
    agreed = lab.join(same, "rep").select(F.col("id").alias("node"), "val")
    return agreed.union(scalars.select("node", "val").join(lab.select(F.col("id").alias("node")), "node", "left_anti"))


def made_cells(wanted: DataFrame, cells: DataFrame, fresh: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Cells of the values ``wanted`` (val, kind): those there are, else offset 0 of a node that ``fresh`` names; and the sites of new globals."""
    at = wanted.join(cells.select("val", "node", "off"), "val", "left")
    out = at.select("val", "kind", F.coalesce("node", fresh(F.col("val"))).alias("node"), F.coalesce("off", F.lit(0).cast("long")).alias("off"), F.col("node").isNull().alias("is_new"))
    return out, out.filter("is_new and kind = 'global'").select("node", "val")


def has_cell(values: DataFrame, cells: DataFrame) -> DataFrame:
    """val, found: whether the value has a cell; globals always have."""
    at = values.join(cells.select("val", F.lit(True).alias("at")).distinct(), "val", "left")
    return at.select("val", F.coalesce(F.col("at") | (F.col("kind") == "global"), F.col("kind") == "global").alias("found"))


def members(cells: DataFrame, kind: str) -> DataFrame:
    """The cells of a kind: scalar, formal, ret or global."""
    return cells.filter(F.col("kind") == kind)


def first_to_rest(rows: DataFrame, by: str) -> DataFrame:
    """Equations between the least cell (node, off) of each group and its others: several returns are one, so are all arguments of an alias."""
    cell = F.struct("node", "off")
    least = rows.groupBy(by).agg(F.min(cell).alias("first"))
    rest = rows.select(by, "node", "off").distinct().join(least, by).filter(cell != F.col("first"))
    return rest.select(F.col("first.node").alias("n1"), F.col("first.off").alias("o1"), F.col("node").alias("n2"), F.col("off").alias("o2")).distinct()


def imported(cells: DataFrame, other: DataFrame, kinds: tuple[str, ...] = ("scalar", "global")) -> DataFrame:
    """Equations that make one graph of two: values (kind, val) with a cell in both."""
    b = other.select("kind", "val", F.col("node").alias("n2"), F.col("off").alias("o2"))
    return cells.filter(F.col("kind").isin(*kinds)).join(b, ["kind", "val"]).select(F.col("node").alias("n1"), F.col("off").alias("o1"), "n2", "o2").distinct()


def made_sites(rows: DataFrame, *key: str) -> DataFrame:
    """Call or allocation sites, one for each key."""
    return rows.dropDuplicates(list(key))


def snapshot(cells: DataFrame, shift: int) -> DataFrame:
    """A copy of graphs under ids of their own."""
    return cells.withColumn("graph", F.col("graph") + shift)
