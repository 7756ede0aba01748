"""Alias verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FLAG

UNSURE = FLAG["inttoptr"] | FLAG["ptrtoint"] | FLAG["incomplete"] | FLAG["unknown"]


def may_alias(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """Verdicts (may, no) of cell pairs (node1, off1, node2, off2, flags, collapsed, low_size).

    ``low_size`` is the one size of the types at the lower offset, null if there
    is none or they differ. Fields that only touch may alias unless ``strict``.
    """
    low, high = F.least("off1", "off2"), F.greatest("off1", "off2")
    reaches = low + F.col("low_size") > high if strict else low + F.col("low_size") >= high
    verdict = (
        F.when(F.col("node1").isNull() | F.col("node2").isNull(), "may").when(F.col("flags").bitwiseAND(F.lit(UNSURE)) != 0, "may")
        .when(F.col("node1") != F.col("node2"), "no").when(F.col("collapsed"), "may").when(F.col("low_size").isNull(), "may").when(reaches, "may").otherwise("no")
    )
    return pairs.withColumn("verdict", verdict)


def common_size(types: DataFrame) -> DataFrame:
    """(node, off, size): the size shared by all types accessed there, null if they differ."""
    return types.groupBy("node", "off").agg(F.when(F.min("bytes") == F.max("bytes"), F.min("bytes")).alias("size"))
