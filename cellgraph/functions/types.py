"""Type operators on textual types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ANY_TYPE, OMNI


def gcd(values: Column, steps: int = 96) -> Column:
    """Greatest common divisor of an array of longs (0 for an empty one), by Euclid's steps inside one expression.

    96 steps bound Euclid's algorithm for 64-bit values.
    """
    start = F.lit(0).cast("long")

    def euclid(a: Column, b: Column) -> Column:
        pair = F.struct(F.abs(a).alias("x"), F.abs(b).alias("y"))
        run = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), pair, lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), F.when(p["y"] == 0, F.lit(0).cast("long")).otherwise(F.try_mod(p["x"], p["y"])).alias("y"))))
        return run["x"]

    return F.aggregate(values, start, euclid)


def is_pointer(t: Column) -> Column:
    return t.endswith("*")


def is_byte_pointer(t: Column) -> Column:
    """The omnipotent pointer types."""
    return t.isin("i8*", "[0 x i8]*")


def field_type(t: Column, aware: bool = True, omni: bool = True) -> Column:
    """The link type of a field: unknown when types are off, omni for byte pointers."""
    if not aware:
        return F.lit(ANY_TYPE)
    return F.when(is_byte_pointer(t), OMNI).otherwise(t) if omni else t


def pointer_to(t: Column) -> Column:
    return F.concat(t, F.lit("*"))


def element_of(t: Column) -> Column:
    return F.when(is_pointer(t), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def leaves(types: DataFrame) -> DataFrame:
    """(type, idx, leaf, bytes) with the running byte offset of each leaf."""
    before = Window.partitionBy("type").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return types.withColumn("off", F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("long"))


def type_sizes(leaf_table: DataFrame) -> DataFrame:
    """type, bytes: where the last leaf (off, bytes) of each type ends."""
    return leaf_table.groupBy("type").agg(F.max(F.col("off") + F.col("bytes")).alias("bytes"))


def indexed_offsets(steps: DataFrame, leaf_table: DataFrame) -> DataFrame:
    """inst, off: the byte offset that the indices (inst, type, idx) of an insertion or extraction lead to, one step for each level."""
    at = leaf_table.select("type", "idx", "off")
    return steps.join(at, ["type", "idx"], "left").groupBy("inst").agg(F.sum("off").alias("off"))


def first_primitive(leaf_of: DataFrame, max_depth: int = 64) -> DataFrame:
    """(type, primitive): follow first fields (type, first) to a type without fields; a cycle ends at the type itself.

    Pointer depth is kept: the first primitive of ``T*`` is that of ``T`` with a star.
    """
    from ..operators.fixpoint import cut

    at = cut(leaf_of.select("type", F.col("first").alias("at"), F.array("type").alias("seen")).withColumn("open", F.lit(True)))
    step = leaf_of.select(F.col("type").alias("t"), "first")
    for _ in range(max_depth):
        nxt = at.filter("open").join(step, F.regexp_replace("at", r"\*+$", "") == F.col("t"), "left")
        stars = F.regexp_extract("at", r"(\*+)$", 1)
        looped = F.array_contains("seen", F.col("t"))
        moved = nxt.select("type", F.when(F.col("t").isNull() | looped, F.col("at")).otherwise(F.concat("first", stars)).alias("at"), F.when(F.col("t").isNotNull(), F.array_union("seen", F.array("t"))).otherwise(F.col("seen")).alias("seen"), (F.col("t").isNotNull() & ~looped).alias("open"))
        at = cut(at.filter("not open").union(moved))
        if at.filter("open").isEmpty():
            return at.select("type", F.col("at").alias("primitive"))
    raise RuntimeError("types nest too deeply")
