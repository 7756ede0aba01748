"""Node information and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FLAG
from .fixpoint import ranked


def access_counts(accesses: DataFrame) -> DataFrame:
    """Accesses of each node; a memcpy counts at both ends (rows of (node, n))."""
    return accesses.groupBy("node").agg(F.sum("n").cast("long").alias("accesses"))


def live_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that are read or modified."""
    return nodes.filter(F.col("flags").bitwiseAND(F.lit(FLAG["read"] | FLAG["modified"])) != 0)


def alloc_site_ids(sites: DataFrame) -> DataFrame:
    """Ids from 1 for alloc sites, in order of their first (node, name)."""
    first = sites.groupBy("val").agg(F.min(F.struct("node", "name")).alias("at"))
    return ranked(first, "at", "val", name="site_id").select("val", "site_id")


def topk_nodes(counts: DataFrame, k: int = 20) -> DataFrame:
    """The k most accessed nodes with their integer share of all accesses in percent."""
    total = counts.agg(F.sum("accesses").alias("total"))
    top = counts.filter("accesses > 0").orderBy(F.desc("accesses"), "node").limit(k)
    return top.withColumn("k", F.lit(0)).join(total.withColumn("k", F.lit(0)), "k").select("node", "accesses", F.expr("accesses * 100 div total").cast("long").alias("percent"))


def node_kinds(nodes: DataFrame, accessed: DataFrame) -> DataFrame:
    """Counts of live, typed, untyped and collapsed nodes."""
    live = live_nodes(nodes)
    typed = live.join(accessed.select("node").distinct().withColumn("typed", F.lit(1)), "node", "left")
    return typed.agg(
        F.count(F.lit(1)).alias("live"), F.count("typed").alias("typed"), F.count_if(F.col("typed").isNull() & ~F.col("collapsed")).alias("untyped"), F.count_if("collapsed").alias("collapsed_nodes")
    )


def fan_out(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes, links, largest number of links of a node, and the average in thousandths."""
    out = links.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    per = nodes.select("node").join(out, "node", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").cast("long").alias("links"), F.max("n").cast("long").alias("max_fan_out"), F.expr("sum(n) * 1000 div count(1)").cast("long").alias("avg_fan_out_milli"))


def orphans(nodes: DataFrame, sites: DataFrame, counts: DataFrame) -> DataFrame:
    """Alloc-site totals, most sites of a node, nodes without a site and the accesses to those."""
    n = sites.groupBy("node").agg(F.count_distinct("val").alias("n"))
    per = nodes.select("node").join(n, "node", "left").join(counts, "node", "left")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("sites"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_sites"), F.count_if(F.col("n").isNull()).alias("orphan_nodes"), F.coalesce(F.sum(F.when(F.col("n").isNull(), F.col("accesses"))), F.lit(0)).cast("long").alias("orphan_accesses"))


def type_disparity(sites: DataFrame, k: int = 20) -> DataFrame:
    """The k nodes whose alloc sites have most distinct types; ties by node."""
    return sites.groupBy("node").agg(F.count_distinct("type").alias("types")).orderBy(F.desc("types"), "node").limit(k)
