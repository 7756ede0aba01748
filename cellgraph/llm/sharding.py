"""Sharding by sampled splitters: near-equal bytes in every shard.

The key is (MD5 prefix of the text, id), so that equal texts lie side by side
and a group of copies of any size can still be cut. A size-weighted sample of
keys gives splitters; they cut the key space into ranges, whose exact sizes are
then summed. A range that is overfull is subdivided with splitters of its own.
Ranges in key order fill the shards; a range that a shard's boundary falls into
is cut record by record, so that the result does not depend on the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, materialize, release

#: Sampled keys for each range, and at most so many times the mean size of a range.
PER_RANGE = 16
OVERFULL = 4.0


def _u(*cols) -> Column:
    """A fixed pseudo-random number in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _key() -> Column:
    return F.struct("k", "id", "tie")


def _splitters(rows: DataFrame, total: int, parts: int, seed: int) -> list:
    """Quantile boundaries (parts - 1 at most) from a size-weighted key sample of bounded expected size."""
    want = parts * PER_RANGE
    sample = rows.filter(_u("k", "id", "tie", F.lit(seed)) * F.lit(float(total)) < F.col("size") * F.lit(float(want)))
    got = sample.agg(F.sort_array(F.collect_set(_key())).alias("s")).select(
        F.expr(f"array_distinct(transform(filter(sequence(1, {parts}), i -> i < {parts} and size(s) >= {parts}), i -> s[cast(i * size(s) div {parts} as int)]))").alias("b")
    )
    return [tuple(x) for x in got.first()["b"]]


def _range_of(bounds: list) -> Column:
    """How many boundaries lie at or below the row's key: a search over blocks of boundaries, then in one block."""
    if not bounds:
        return F.lit(0).cast("long")
    step = max(1, int(len(bounds) ** 0.5))

    def fixed(some) -> Column:
        value = lambda x: "cast(null as bigint)" if x is None else f"cast({x} as bigint)"
        return F.expr("array(" + ",".join(f"named_struct('k', {value(k)}, 'id', {value(i)}, 'tie', {value(t)})" for k, i, t in some) + ")")

    arr, heads = fixed(bounds), fixed(bounds[::step])
    block = F.size(F.filter(heads, lambda b: b <= _key()))
    inside = F.slice(arr, F.greatest(block - 1, F.lit(0)) * step + 1, F.lit(step))
    return (F.greatest(block - 1, F.lit(0)) * step + F.size(F.filter(inside, lambda b: b <= _key()))).cast("long")


def shard(docs: DataFrame, shards: int = 16, ranges_per_shard: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row to a shard and a slot in it.

    Returns one row per input row: ``id_col``, ``size`` (UTF-8 bytes of the text,
    null: none, plus 1), ``text_crc32``, ``law`` ('bytes'), ``shard`` (0 to
    shards - 1), ``slot`` (gapless from 0 within the shard, in key order) and
    ``grown_shard`` (null: this law is not the key law). A null text has size 1
    and the crc32 of no bytes; null ids sort first. Rows that repeat an id and
    a text keep one row each; they are told apart by a row number among equals.
    An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("k"),
        F.monotonically_increasing_id().alias("tie"),
    )
    rows = materialize(rows, "keys")  # fixes the tie-breaking row numbers, too
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = shards * ranges_per_shard
    first = _splitters(rows, total, parts, 1)
    ranged = rows.withColumn("r", _range_of(first))
    sizes = ranged.groupBy("r").agg(F.sum("size").alias("bytes"))
    over = [r[0] for r in sizes.filter(F.col("bytes") * F.lit(parts) > F.lit(OVERFULL * total)).select("r").collect()]  # at most one for each range
    if over and first:
        inside = ranged.filter(F.col("r").isin(over))
        more = _splitters(inside, inside.agg(F.sum("size")).first()[0], parts, 2)
        first = sorted(set(first) | set(more), key=lambda b: tuple((x is not None, x or 0) for x in b))
        ranged = rows.withColumn("r", _range_of(first))
    by_range = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("r").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    sums = materialize(sums.select("r", "bytes", "n", F.coalesce(F.sum("bytes").over(by_range), F.lit(0)).alias("before")), "ranges")  # one row for each range
    in_range = Window.partitionBy("r").orderBy("k", "id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(sums.select("r", "before")), "r")  # as many rows as splitters
    cum = F.col("before") + F.coalesce(F.sum("size").over(in_range), F.lit(0))
    placed = placed.select("r", "id", "size", "crc", "k", "tie", F.least(F.lit(shards - 1), F.floor((2 * cum + F.col("size")) * shards / F.lit(2 * max(total, 1)))).cast("int").alias("shard"))
    placed = materialize(placed.withColumn("at", F.row_number().over(Window.partitionBy("r").orderBy("k", "id", "tie"))), "placed")
    release(rows)
    cells = placed.groupBy("r", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    cells = cells.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = materialize(cells.select("r", "shard", "low", "offset"), "cells")  # ranges plus shards at most
    out = placed.join(F.broadcast(cells), ["r", "shard"])
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("at") - F.col("low")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", **kw) -> None:
    """Write the documents into one folder for each shard; ids must be unique and not null."""
    where = shard(docs, shards, id_col=id_col, **kw).select(id_col, "shard", "slot")
    docs.join(where, id_col).repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    """All documents into 16 shards of near-equal bytes."""
    return shard(load(spark, sf_dir, "documents"))
