"""Text sinks: CSV, DOT and listings as DataFrames of lines, and writers for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import flag_letters


def csv_lines(sites: DataFrame) -> DataFrame:
    """Lines alloc_site,ds_node."""
    return sites.select(F.concat_ws(",", "name", F.col("node").cast("string")).alias("line"))


def write_csv(sites: DataFrame, path: str) -> None:
    sites.select(F.col("name").alias("alloc_site"), F.col("node").alias("ds_node")).write.csv(path, header=True)


def site_sets(sites: DataFrame) -> DataFrame:
    """Each site with the ordered set of its nodes."""
    nodes = F.transform(F.sort_array(F.collect_set("node")), lambda n: n.cast("string"))
    return sites.groupBy("val").agg(F.concat(F.lit("["), F.array_join(nodes, ","), F.lit("]")).alias("nodes"))


def dot_nodes(nodes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One DOT statement for each node; ``labels`` (node, label) gives its types, else it is void."""
    rows = nodes.join(labels, "node", "left") if labels is not None else nodes.withColumn("label", F.lit(None).cast("string"))
    name = F.concat(F.lit("n"), F.col("node").cast("string"))
    return rows.select("node", F.concat(name, F.lit(' [shape=record,label="{'), F.coalesce("label", F.lit("void")), F.lit("}:"), flag_letters(F.col("flags")), F.lit('"];')).alias("line"))


def _edge_line() -> Column:
    text = lambda c: F.col(c).cast("string")
    return F.concat(F.lit("n"), text("node"), F.lit(" -> n"), text("dst"), F.lit(' [label="'), text("off"), F.lit(", "), text("dst_off"), F.lit('"];'))


def dot_edges(links: DataFrame) -> DataFrame:
    return links.select(_edge_line().alias("line"))


def type_labels(accessed: DataFrame) -> DataFrame:
    """(node, label): offset:type|type,... in order of offsets."""
    at = accessed.groupBy("node", "off").agg(F.array_join(F.sort_array(F.collect_set("type")), "|").alias("t"))
    cell = F.struct("off", F.concat(F.col("off").cast("string"), F.lit(":"), F.col("t")).alias("s"))
    return at.groupBy("node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(cell)), lambda x: x["s"]), ",").alias("label"))


def callgraph_dot(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """One statement for each edge between named functions."""
    a, b = functions.select(F.col("func").alias("caller"), F.col("name").alias("x")), functions.select(F.col("func").alias("callee"), F.col("name").alias("y"))
    return calls.join(a, "caller").join(b, "callee").select(F.concat(F.lit('"'), "x", F.lit('" -> "'), "y", F.lit('";')).alias("line")).distinct()


def write_dot(nodes: DataFrame, links: DataFrame, path: str, by: str | None = None) -> None:
    """Statements of all graphs as text; ``by`` names a column that gives each graph its own folder."""
    lines = dot_nodes(nodes).select("line").union(dot_edges(links).select("line"))
    if by is None:
        lines.write.text(path)
    else:
        owner = nodes.select(by, "node").distinct()
        n = dot_nodes(nodes).join(owner, "node").select(by, "line")
        # edges keep their labels: the statement is made beside the owner's column
        e = links.join(owner, "node").withColumn("line", _edge_line()).select(by, "line")
        n.union(e).write.partitionBy(by).text(path)


def colored_nodes(nodes: DataFrame, sim: DataFrame) -> DataFrame:
    """node, line: DOT statements with a colour for each image under a simulation (n1, n2): nodes that one node simulates are alike; white without image."""
    of = sim.groupBy(F.col("n1").alias("node")).agg(F.min("n2").alias("image"))
    hue = F.lower(F.lpad(F.hex(F.pmod(F.col("image") * F.lit(2654435761), F.lit(16777216))), 6, "0"))
    rows = nodes.select("node").join(of, "node", "left")
    return rows.select("node", F.concat(F.lit("n"), F.col("node").cast("string"), F.lit(' [style=filled,fillcolor="#'), F.coalesce(hue, F.lit("ffffff")), F.lit('"];')).alias("line"))


def text_dump(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """part, key, line: the textual dump of a graph: a line for each node, then one for each value with its cells."""
    text = lambda c: F.col(c).cast("string")
    n = nodes.select(F.lit(0).alias("part"), F.col("node").alias("key"), F.concat(F.lit("Node "), text("node"), F.lit(": flags=["), flag_letters(F.col("flags")), F.lit("] size="), text("size")).alias("line"))
    at = F.transform(F.sort_array(F.collect_set(F.struct("node", "off"))), lambda c: F.concat(F.lit("("), c["node"].cast("string"), F.lit(", "), c["off"].cast("string"), F.lit(")")))
    return n.union(cells.groupBy("val").agg(F.array_join(at, " ").alias("at")).select(F.lit(1), "val", F.concat(F.lit("Value "), text("val"), F.lit(": "), F.col("at"))))


def write_accesses(accesses: DataFrame, path: str) -> None:
    """The instrumented program: its memory accesses as a table."""
    accesses.write.parquet(path)


def alias_report(verdicts: DataFrame) -> DataFrame:
    """verdict, pairs: how often each alias verdict was given."""
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("pairs"))
