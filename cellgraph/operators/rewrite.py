"""Rewrites of a program's facts before the analysis: integers that carry pointers become pointers.

Tables: loads (func, dst, ptr, type), stores (func, ptr, val, type), casts of
pointers to integers (dst, src) and of integers to pointers (dst, src).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import is_pointer
from .fixpoint import cut

#: Functions whose names begin so are left as they are.
SKIPPED = ("shadow.", "verifier.")
BYTE_POINTER = "i8*"


def copied_integers(loads: DataFrame, stores: DataFrame) -> DataFrame:
    """Values (val) that an integer load yields and whose only uses are stores of them: the pair moves a pointer."""
    from_load = loads.filter(~is_pointer(F.col("type"))).select(F.col("dst").alias("val"))
    return stores.filter(~is_pointer(F.col("type"))).join(from_load, "val", "left_semi").select("val").distinct()


def as_pointers(rows: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Loads or stores whose ``column`` is one of the values (val), with a pointer type."""
    hit = values.select(F.col("val").alias(column), F.lit(True).alias("hit"))
    return rows.join(hit, column, "left").withColumn("type", F.when(F.col("hit"), BYTE_POINTER).otherwise(F.col("type"))).drop("hit")


def stores_of_casts(stores: DataFrame, casts: DataFrame) -> DataFrame:
    """Stores in which a value that was cast from a pointer is the pointer itself."""
    c = casts.select(F.col("dst").alias("val"), F.col("src").alias("pointer"))
    out = stores.join(c, "val", "left")
    return out.select("func", "ptr", F.coalesce("pointer", "val").alias("val"), F.when(F.col("pointer").isNotNull(), BYTE_POINTER).otherwise(F.col("type")).alias("type"))


def stores_through_casts(stores: DataFrame, bitcasts: DataFrame) -> DataFrame:
    """Stores of pointers whose slot is a bitcast, written to the slot that was cast."""
    b = bitcasts.select(F.col("dst").alias("ptr"), F.col("src").alias("slot"))
    out = stores.join(b, "ptr", "left")
    through = F.col("slot").isNotNull() & is_pointer(F.col("type"))
    return out.select("func", F.when(through, F.col("slot")).otherwise(F.col("ptr")).alias("ptr"), "val", "type")


def recovered_pointers(made: DataFrame, arithmetic: DataFrame, casts: DataFrame, most: int = 10_000) -> DataFrame:
    """dst, base, off of pointers made of integers (dst, src): the pointer that the integer was cast from, and the constants added on the way.

    ``arithmetic`` is (dst, src, add): sums and differences with a constant. Each
    step halves no chain but moves all open values one instruction up; the loop
    raises for chains of more than ``most``.
    """
    step = cut(arithmetic.select(F.col("dst").alias("at"), F.col("src").alias("up"), "add"))
    root = casts.select(F.col("dst").alias("at"), F.col("src").alias("base"))
    open_, done = cut(made.select("dst", F.col("src").alias("at"), F.lit(0).cast("long").alias("off"))), None
    for _ in range(most):
        if open_.isEmpty():
            return done if done is not None else open_.select("dst", F.col("at").alias("base"), "off")
        hit = open_.join(root, "at").select("dst", "base", "off")
        done = cut(hit if done is None else done.union(hit))
        open_ = cut(open_.join(root, "at", "left_anti").join(step, "at").select("dst", F.col("up").alias("at"), (F.col("off") + F.col("add")).alias("off")))
    raise RuntimeError(f"integer chains of more than {most} steps")


def pointer_phis(phis: DataFrame, casts: DataFrame) -> DataFrame:
    """dst, src of phis (dst, src) of integers that all were cast from pointers: phis of those pointers."""
    c = casts.select(F.col("dst").alias("src"), F.col("src").alias("pointer"))
    rows = phis.join(c, "src", "left")
    every = rows.groupBy("dst").agg(F.count_if(F.col("pointer").isNull()).alias("others")).filter("others = 0")
    return rows.join(every, "dst", "left_semi").select("dst", F.col("pointer").alias("src")).distinct()


def rewritten_functions(functions: DataFrame) -> DataFrame:
    """The functions (func, name) that are rewritten."""
    skip = F.lit(False)
    for prefix in SKIPPED:
        skip = skip | F.col("name").startswith(prefix)
    return functions.filter(~skip)


def named(values: DataFrame) -> DataFrame:
    """Values (val, name) with a name for those that have none."""
    return values.withColumn("name", F.coalesce(F.when(F.col("name") != "", F.col("name")), F.concat(F.lit("_"), F.col("val").cast("string"))))


def pointers_for_integers(functions: DataFrame, loads: DataFrame, stores: DataFrame, casts: DataFrame, bitcasts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loads and stores of a program after all rewrites; those of skipped functions stay."""
    todo = rewritten_functions(functions).select("func")
    own = lambda df: df.join(todo, "func", "left_semi")
    other = lambda df: df.join(todo, "func", "left_anti")
    moved = cut(copied_integers(own(loads), own(stores)))
    new_stores = stores_through_casts(stores_of_casts(as_pointers(own(stores), moved, "val").select("func", "ptr", "val", "type"), casts), bitcasts)
    new_loads = as_pointers(own(loads), moved.withColumnRenamed("val", "val"), "dst").select("func", "dst", "ptr", "type")
    return new_loads.union(other(loads).select("func", "dst", "ptr", "type")), new_stores.union(other(stores).select("func", "ptr", "val", "type"))
