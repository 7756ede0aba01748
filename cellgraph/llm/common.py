"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Up to this many ids (16 MB of longs) a side is broadcast after it was counted.
BROADCAST_IDS = 1_000_000
# Batches with texts are taken and handed on in pieces of so many rows.
PIECE_ROWS = 1000


def ship(module: str) -> None:
    """Pickle a module's functions by value, so that workers need not import it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def pieces(batches):
    """The rows of all batches, at most PIECE_ROWS at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(at, PIECE_ROWS)


def return_memory() -> None:
    """Give freed memory back to the system: Arrow's, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """``run`` for mapInArrow over pieces; what the task has freed goes back after it, as the worker stays for later tasks."""

    def over(batches):
        try:
            yield from run(pieces(batches))
        finally:
            return_memory()

    return over


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where a local session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            named = tempfile.mkdtemp(prefix="cellgraph-")
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, what: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cellgraph_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote; only for tables nothing will read again."""
    for df in tables:
        path = getattr(df, "_cellgraph_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def within_ids(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join with materialized ids; broadcast only up to BROADCAST_IDS of them."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1_000_003))).first()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has columns ``a`` and ``b`` (long). Returns ``id``, ``component``
    (the smallest id reachable) for every id that occurs in an edge between two
    different ids; null ends and loops are ignored, repeated edges count once.
    Each round is materialized in the shared folder. Raises when it has not
    converged after ``max_rounds`` rounds.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.expr("a <> b").alias("real"))
    e = materialize(e.filter("real").select("a", "b").distinct(), "edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: every larger end points to the least of its smaller neighbours
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = materialize(small, "edges")
        release(e)
        e, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    out = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return out.union(out.select(F.col("component").alias("id"), "component").distinct())
