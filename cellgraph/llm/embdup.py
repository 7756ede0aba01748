"""Embedding near-duplicates by random-hyperplane sign hashing in several tables.

Vectors that are equal (with equal labels) are one class with a count. A class
has one signature, the signs of its projections on random hyperplanes; a table
is a random subset of them, and the bucket of a class in a table is its signs
there. How many signs a table takes follows from the size of the largest label,
so that buckets stay small at every size; how many tables there are follows
from the recall that is asked for.

Only keys and signatures are moved to the buckets. Classes that meet another
one there with few differing signs, in no earlier table, then fetch their
vectors, and cosines decide. A bucket of more than ``block`` classes is cut
into blocks, and every pair of its blocks is compared on its own: nothing holds
more than two blocks. What leaves a pair of blocks is, for each class, how many
vectors it is linked to and one edge of a spanning forest, not the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import acos, ceil, comb, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, connected_components, load, materialize, release, ship

ship(__name__)


@dataclass(frozen=True)
class Config:
    """miss: bound on the probability that a pair just at the threshold shares no table, or differs in too many signs.

    per_bucket: classes of the largest label for each bucket of a table, as the
    number of signs allows (``least_bits`` to ``most_bits``).
    """

    threshold: float = 0.93
    miss: float = 2e-4
    per_bucket: int = 64
    least_bits: int = 8
    most_bits: int = 24
    block: int = 1500
    seed: int = 99

    def bits(self, largest: int) -> int:
        """Signs of a table, where the largest label has so many classes."""
        return max(self.least_bits, min(self.most_bits, ceil(log2(max(1, largest) / self.per_bucket)) if largest > self.per_bucket else 0))

    def signs(self, bits: int) -> int:
        """Signs of a signature, in whole words: the more a table takes, the more are needed for tables to differ."""
        return 64 * ceil(bits * bits / 32)

    def differing(self, bits: int) -> list[float]:
        """Probability of each number of differing signs of a pair at the threshold."""
        n, p = self.signs(bits), acos(self.threshold) / pi
        out = [(1 - p) ** n]
        for d in range(n):
            out.append(out[-1] * (n - d) / (d + 1) * p / (1 - p))
        return out

    def missed(self, bits: int, tables: int) -> float:
        """Probability that no table holds both vectors of a pair at the threshold, over the number of signs that differ."""
        n, every = self.signs(bits), comb(self.signs(bits), bits)
        return sum(q * (1 - comb(n - d, bits) / every) ** tables for d, q in enumerate(self.differing(bits)))

    def tables(self, bits: int) -> int:
        tables = 4
        while self.missed(bits, tables) > self.miss / 2:
            tables += 2
        return tables

    def most_differing(self, bits: int) -> int:
        """Signs that may differ: beyond it lies a pair at the threshold with probability below miss / 2."""
        left, chance = 1.0, self.differing(bits)
        for d, q in enumerate(chance):
            left -= q
            if left <= self.miss / 2:
                return d
        return len(chance)


@lru_cache(8)
def masks(cfg: Config, bits: int, tables: int) -> np.ndarray:
    """Each table's signs, as words of 64 bits."""
    n, rng = cfg.signs(bits), np.random.default_rng([cfg.seed, bits])
    out = np.zeros((tables, n), np.uint8)
    for row in out:
        row[rng.choice(n, bits, replace=False)] = 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def usable(vector: str) -> F.Column:
    """Not null, not empty, all components finite, not all zero."""
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles, divided by a power of two (which rounds nothing) so that no square over- or underflows."""
    x = np.asarray(x, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def cosines(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of each pair of scaled rows, in double precision."""
    return (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1))


def linked(u: np.ndarray, v: np.ndarray, threshold: float) -> np.ndarray:
    """Which scaled rows of u have a cosine of at least ``threshold`` with which of v.

    A matrix product decides all pairs but those within its error of the threshold.
    """
    near = (u / np.sqrt((u * u).sum(1, keepdims=True))) @ (v / np.sqrt((v * v).sum(1, keepdims=True))).T
    out = near >= threshold
    i, j = np.nonzero(np.abs(near - threshold) <= 1e-9)
    for at in range(0, len(i), 4096):
        a, b = i[at : at + 4096], j[at : at + 4096]
        out[a, b] = cosines(u[a], v[b]) >= threshold
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _signer(cfg: Config, bits: int, tables: int):
    """Adds the signature (binary) and the codes, a hash of the signs of each table."""

    def run(batches):
        chosen, made = masks(cfg, bits, tables), {}
        mixer = np.random.default_rng([cfg.seed, 5]).integers(1, 2**63, chosen.shape[1], np.uint64) | np.uint64(1)
        for batch in batches:
            sizes = np.array(batch.column("dim"))
            signature, codes = [None] * batch.num_rows, [None] * batch.num_rows
            for d in np.unique(sizes):
                if d not in made:
                    made[d] = np.random.default_rng([cfg.seed, int(d)]).normal(size=(int(d), cfg.signs(bits)))
                for at in np.array_split(np.flatnonzero(sizes == d), -(-batch.num_rows // 2000)):
                    if not len(at):
                        continue
                    x = scaled(_vectors(batch.column("v").take(pa.array(at))))
                    words = np.packbits(x @ made[d] > 0, axis=1, bitorder="little").view(np.uint64)
                    key = np.zeros((len(at), tables), np.uint64)
                    for w in range(words.shape[1]):
                        key = (key + (words[:, w, None] & chosen[None, :, w])) * mixer[w]
                        key ^= key >> np.uint64(29)
                    for k, i in enumerate(at):
                        signature[i], codes[i] = words[k].tobytes(), key[k].view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signature, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], [*batch.schema.names, "sig", "codes"])

    return run


def _fresh(sig: np.ndarray, side: np.ndarray, table: int, chosen: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket (of its two blocks, where side is not 0 throughout) with few differing signs that meet in no earlier table."""
    if side.any():
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    else:
        left = right = np.arange(len(sig))
    differ = np.zeros((len(left), len(right)), np.uint8 if sig.shape[1] < 4 else np.uint16)
    for w in range(sig.shape[1]):
        differ += np.bitwise_count(sig[left, w, None] ^ sig[None, right, w])
    i, j = np.nonzero(differ <= most)
    i, j = left[i], right[j]
    if left is right:
        i, j = i[i < j], j[i < j]
    if table and len(i):
        keep = np.ones(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            x = sig[i[at : at + (1 << 16)]] ^ sig[j[at : at + (1 << 16)]]
            for t in range(table):
                keep[at : at + (1 << 16)] &= ((x & chosen[t]) != 0).any(1)
        i, j = i[keep], j[keep]
    return i, j


def _runs(batches, keys: int):
    """Consecutive rows of equal first ``keys`` columns, each run as one record batch; rows come sorted by them."""
    held: list[pa.RecordBatch] = []

    def first_row(b):
        return tuple(b.column(k)[0].as_py() for k in range(keys))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        turn = np.zeros(n - 1, bool)
        for k in range(keys):
            c = batch.column(k)
            turn |= np.asarray(pa.compute.not_equal(c.slice(1), c.slice(0, n - 1)))
        cuts = [0, *(np.flatnonzero(turn) + 1).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(a, b - a)
            if held and (a > 0 or first_row(held[0]) != first_row(part)):
                yield held
                held = []
            held.append(part)
    if held:
        yield held


def _joined(parts: list[pa.RecordBatch], name: str) -> pa.Array:
    return parts[0].column(name) if len(parts) == 1 else pa.concat_arrays([p.column(name) for p in parts])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


GROUP = ("label", "dim", "code", "tbl", "blk")


def _candidates(cfg: Config, bits: int, tables: int):
    """The rows that have a partner in their bucket or pair of blocks."""

    def run(batches):
        chosen, most = masks(cfg, bits, tables), cfg.most_differing(bits)
        out, rows = [], 0
        for parts in _runs(batches, len(GROUP)):
            if sum(p.num_rows for p in parts) < 2:
                continue
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
            i, j = _fresh(_signatures(whole.column("sig")), np.array(whole.column("side")), whole.column("tbl")[0].as_py(), chosen, most)
            if len(i):
                out.append(whole.take(pa.array(np.union1d(i, j))))
                rows += out[-1].num_rows
            if rows > 20_000:
                yield from out
                out, rows = [], 0
        yield from out

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, lab[i], low)
        np.minimum.at(new, lab[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _linker(cfg: Config, bits: int, tables: int):
    """cls, far (vectors that the class is linked to in its bucket or pair of blocks), other (the least class of its component there)."""

    def run(batches):
        chosen, most = masks(cfg, bits, tables), cfg.most_differing(bits)
        for parts in _runs(batches, len(GROUP)):
            if sum(p.num_rows for p in parts) < 2:
                continue
            x, side = scaled(_vectors(_joined(parts, "v"))), np.array(_joined(parts, "side"))
            i, j = _fresh(_signatures(_joined(parts, "sig")), side, parts[0].column("tbl")[0].as_py(), chosen, most)
            if not len(i):
                continue
            left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(x)),) * 2
            at = np.zeros(len(x), np.int64)
            at[right] = np.arange(len(right))
            near = linked(x[left], x[right], cfg.threshold)
            keep = near[np.searchsorted(left, i), at[j]]
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            n, cls = np.array(_joined(parts, "n")), np.array(_joined(parts, "cls"))
            far = np.zeros(len(x), np.int64)
            np.add.at(far, i, n[j])
            np.add.at(far, j, n[i])
            lab = _forest(i, j, len(x))
            met = np.flatnonzero(far)
            yield pa.RecordBatch.from_arrays([pa.array(cls[met]), pa.array(far[met]), pa.array(cls[lab[met]])], ["cls", "far", "other"])

    return run


def near_duplicates(rows: DataFrame, cfg: Config = Config(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Link vectors of equal, non-null label at cosine ``threshold`` or more.

    Returns one row per input row: ``id_col``, ``n_links`` (other rows linked
    directly), ``component_id`` (smallest id reachable, itself included) and
    ``kept``. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do those with a null label or id; they
    are components of their own and kept. Vectors of different lengths never
    link. Rows that repeat an id are nodes of one id: each counts the others
    that are linked, and all share the component. An empty table gives an empty
    result. Components of any finite size are compared without overflow.
    """
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    good = usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull()
    keyed = base.filter(good).select("id", "label", "v", F.xxhash64(F.lit(1), "v").alias("x1"), F.xxhash64(F.lit(2), "v").alias("x2"))
    key = ["label", "x1", "x2"]  # 128 bits stand for a vector
    classes = keyed.groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = materialize(classes.select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("cls")), "classes")  # written: the keys stay
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
    bits = cfg.bits(largest)
    tables = cfg.tables(bits)
    kind = {f.name: f.dataType.simpleString() for f in classes.schema}
    coded = classes.select("cls", "label", "dim", "v").mapInArrow(_signer(cfg, bits, tables), f"cls long, label {kind['label']}, dim int, v {kind['v']}, sig binary, codes array<long>")
    coded = materialize(coded.drop("v"), "codes")
    spread = coded.select("cls", "label", "dim", "sig", F.posexplode("codes").alias("tbl", "code"))
    # buckets of more than a block: few, each of so many rows
    hot = coded.select("label", "dim", F.posexplode("codes").alias("tbl", "code")).groupBy("label", "dim", "code", "tbl").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > cfg.block)
    hot = materialize(hot, "hot")
    spread = spread.join(F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot, ["label", "dim", "code", "tbl"], "left")
    blocks = F.coalesce(F.ceil(F.col("m") / F.lit(cfg.block)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int")
    # pairs of blocks (lo, hi): side 0 is lo's, side 1 hi's
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("lo"), F.greatest(o, F.col("own")).alias("hi"), (F.col("own") > o).cast("int").alias("side")))
    spread = spread.withColumn("blocks", blocks).withColumn("own", own)
    tasks = spread.select("label", "dim", "code", "tbl", "cls", "sig", F.explode(pairs).alias("p"))
    tasks = tasks.select("label", "dim", "code", "tbl", (F.col("p.lo") * F.lit(1 << 32) + F.col("p.hi")).alias("blk"), "p.side", "cls", "sig")
    schema = f"label {kind['label']}, dim int, code long, tbl int, blk long, side int, cls long, sig binary"
    met = materialize(tasks.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_candidates(cfg, bits, tables), schema), "met")
    full = met.join(classes.select("cls", "n", "v"), "cls").select(*GROUP, "side", "cls", "sig", "n", "v")
    links = materialize(full.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_linker(cfg, bits, tables), "cls long, far long, other long"), "links")
    release(coded, hot, met)
    comp = connected_components(links.select(F.col("cls").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "cls")
    near = links.groupBy("cls").agg(F.sum("far").alias("far"))
    near = classes.select(*key, "cls", "rep", "n").join(near, "cls", "left").join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    # a repeated id joins all classes that it stands for
    near = materialize(near.select(*key, "rep", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), "component"), "near")
    linked_rows = keyed.select("id", *key).join(near, key).select("id", "n_links", "component")
    least = near.groupBy("component").agg(F.min("rep").alias("component_id"))
    some = materialize(linked_rows.join(least, "component").select("id", "n_links", "component_id"), "some")
    shared = some.groupBy("id").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).filter("lo < hi")
    if not shared.isEmpty():
        more = some.join(shared.select("id"), "id", "left_semi").select(F.col("id").alias("a"), F.col("component_id").alias("b"))
        root = connected_components(more).withColumnRenamed("id", "component_id")
        some = some.join(root, "component_id", "left").select("id", "n_links", F.coalesce("component", "component_id").alias("component_id"))
    rest = base.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = some.union(rest)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_hyperplane_tables(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates of all embeddings: cosine 0.93 or more within a label."""
    return near_duplicates(load(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE good AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93::DOUBLE),
reach AS (
  SELECT vec_id AS id, vec_id AS other FROM embeddings WHERE vec_id IS NOT NULL
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
