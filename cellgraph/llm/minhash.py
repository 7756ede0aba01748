"""MinHash near-duplicates with odd sketches.

Each document's set of word shingles gives ``bands * rows`` MinHash samples.
The samples are cut into bands, whose equality makes two documents candidates,
and folded into a parity bitmap (odd sketch): the population count of the XOR
of two bitmaps estimates how many samples differ. Candidates whose estimate
stays well below the threshold are dropped, all others are compared on their
full sets. Documents with equal sets are one class from the start, so that a
large group of copies costs one row. Within a bucket every document is compared
with the bucket's hub, the one with most company in all its buckets; only documents that are then still in different
components are compared with each other, so no link between components is
lost and no group emits all its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, connected_components, lean, materialize, release, ship, within_ids

ship(__name__)


@dataclass(frozen=True)
class Config:
    """words: words of a shingle; percent: least Jaccard similarity in hundredths.

    With 40 bands of 8 rows a pair at 0.85 is missed with probability 3e-6, at
    0.8 with 6e-4; ``for_similarity`` picks the bands from the threshold.
    """

    words: int = 5
    percent: int = 80
    bands: int = 54
    rows: int = 6
    sketch_longs: int = 8
    seed: int = 20231

    @property
    def max_differing_bits(self) -> int:
        """XOR bits beyond which a pair at the threshold is 4.5 deviations away."""
        n, k = 64 * self.sketch_longs, self.bands * self.rows
        j = self.percent / 100
        low = max(0.0, j - 4.5 * (j * (1 - j) / k) ** 0.5)
        mean = n / 2 * (1 - (1 - 2 / n) ** (2 * k * (1 - low)))
        return int(mean + 3.0 * (mean * (1 - mean / n)) ** 0.5) + 1


def for_similarity(words: int, percent: int) -> Config:
    """Bands of 8 rows from 0.85 on, of 6 rows below; misses at the threshold stay under 1e-5."""
    return Config(words, percent, 40, 8) if percent >= 85 else Config(words, percent, 54, 6)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEGMENT = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of ASCII-lowered UTF-8 bytes.

    A word's hash is a polynomial in its bytes modulo 2**64, taken from prefix
    sums over the whole text and mixed. Long texts are cut at white space into
    segments of about SEGMENT bytes, so that the arrays stay small.
    """

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = _powers(_P, n), _powers(pow(_P, -1, 2**64), n)

    def words(self, text: bytes) -> np.ndarray:
        text = text.lower()
        if len(text) <= SEGMENT:
            return self._segment(text)
        parts, at = [], 0
        while at < len(text):
            end = at + SEGMENT
            while end < len(text) and text[end] != 32 and not 9 <= text[end] <= 13:
                end += 1
            parts.append(self._segment(text[at:end]))
            at = end
        return np.concatenate(parts)

    def _segment(self, text: bytes) -> np.ndarray:
        c = np.frombuffer(text, np.uint8)
        n = len(c)
        edge = np.zeros(n + 2, np.int8)
        edge[1:-1] = (c != 32) & ((c < 9) | (c > 13))
        turn = np.flatnonzero(edge[1:] != edge[:-1])
        start, end = turn[::2], turn[1::2]
        self._grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((c.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        return _mix((total[end] - total[start]) * self.down[start])


def shingle_set(text: bytes | None, words: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of all its words as one if they are fewer."""
    h = hasher.words(text or b"")
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def _samplers(cfg: Config) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(cfg.seed)
    k = cfg.bands * cfg.rows
    return rng.integers(1, 2**32, k, np.uint32) | np.uint32(1), rng.integers(0, 2**32, k, np.uint32)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One least value for each of the hash functions, in blocks of bounded size."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 64):
        block = np.multiply.outer(x[i : i + 64], a)
        block += b
        np.minimum(low, block.min(axis=0), out=low)
    return low


def odd_sketch(samples: np.ndarray, longs: int) -> np.ndarray:
    """Bit i is the parity of the number of (function, value) samples that fall on it."""
    pos = _mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32)))
    odd = np.bincount((pos % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _signer(cfg: Config):
    def sign(batches):
        a, b = _samplers(cfg)
        hasher = WordHasher()
        salt = np.arange(cfg.bands, dtype=np.uint64)
        for part in batches:
            ns, d0, d1, bands, sketches = [], [], [], [], []
            for text in part.column(1):
                s = shingle_set(text.as_py(), cfg.words, hasher)
                ns.append(len(s))
                if not len(s):
                    d0.append(0)
                    d1.append(0)
                    bands.append(None)
                    sketches.append(None)
                    continue
                d0.append(int(np.bitwise_xor.reduce(_mix(s)).view(np.int64)))
                d1.append(int(np.add.reduce(_mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)))
                m = minhash(s, a, b)
                key = salt
                for row in m.reshape(cfg.bands, cfg.rows).T:
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64))
                bands.append(key.view(np.int64))
                sketches.append(odd_sketch(m, cfg.sketch_longs))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ns, pa.int64()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["id", "n", "d0", "d1", "bands", "sketch"],
            )

    return sign


def signatures(docs: DataFrame, cfg: Config, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), d0 and d1 (128-bit digest of the set), bands, sketch; both null for an empty set."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(lean(_signer(cfg)), "id long, n long, d0 long, d1 long, bands array<long>, sketch array<long>")


def _confirmer(cfg: Config):
    def confirm(batches):
        hasher = WordHasher()
        last, own = None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                key = (a[i].as_py(), ta[i].as_py())
                if key != last:
                    last, own = key, shingle_set(key[1], cfg.words, hasher)
                other = shingle_set(tb[i].as_py(), cfg.words, hasher)
                both = len(np.intersect1d(own, other, assume_unique=True))
                union = len(own) + len(other) - both
                keep.append(union > 0 and 100 * both >= cfg.percent * union)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, cfg: Config) -> DataFrame:
    """Of the candidate pairs (a, b), those linked: odd sketches first, full sets after."""
    sk = reps.select("id", "sketch")
    near = pairs.join(sk.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a")
    near = near.join(sk.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    bits = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = materialize(near.filter(bits <= cfg.max_differing_bits).select("a", "b").distinct(), "near")
    ids = materialize(near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct(), "ids")
    t = within_ids(texts, ids, "id")
    full = near.join(t.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    full = full.join(t.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    out = materialize(full.mapInArrow(lean(_confirmer(cfg)), "a long, b long").distinct(), "links")
    release(near, ids)
    return out


def _linked(rows: list, cfg: Config, hasher: WordHasher) -> list[tuple[int, int]]:
    """Linked pairs of different components in one bucket, or between two blocks of it.

    A row is (id, component, side, band, bands, sketch, text). Odd sketches come
    first; if any pair passes, the intersections of all full sets are counted at
    once, by products of incidence matrices over the shingles that are shared.
    A pair is left out if an earlier band has both in one bucket.
    """
    comp = np.array([r[1] for r in rows])
    side = np.array([r[2] for r in rows], np.int8)
    wanted = np.triu(comp[:, None] != comp[None, :], 1)
    if side.any():
        wanted = (comp[:, None] != comp[None, :]) & (side[:, None] < side[None, :])
    bits = np.unpackbits(np.array([r[5] for r in rows], np.int64).view(np.uint8), axis=1).astype(np.float32)
    on = bits.sum(1)
    wanted &= on[:, None] + on[None, :] - 2 * (bits @ bits.T) <= cfg.max_differing_bits
    bands = np.array([r[4] for r in rows], np.int64)
    for k in range(rows[0][3]):
        if not wanted.any():
            return []
        wanted &= bands[:, None, k] != bands[None, :, k]
    if not wanted.any():
        return []
    sets = [shingle_set(r[6], cfg.words, hasher) for r in rows]
    sizes = np.array([len(x) for x in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.append(True, every[1:] != every[:-1])
    column = np.cumsum(start) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    both = np.zeros((len(rows), len(rows)))
    at = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 2049, 2048))
    for lo, hi in zip(at[:-1], at[1:]):
        m = np.zeros((len(rows), 2048), np.float32)
        m[owner[lo:hi], column[lo:hi] % 2048] = 1
        both += m @ m.T
    linked = wanted & (100 * both >= cfg.percent * (sizes[:, None] + sizes[None, :] - both))
    return [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(linked))]


def _bucket_linker(cfg: Config):
    def run(batches):
        hasher, held, grp = WordHasher(), [], None
        for batch in batches:
            found = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for key, *row in zip(*columns):
                if key != grp:
                    if len(held) > 1:
                        found += _linked(held, cfg, hasher)
                    held, grp = [], key
                held.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
        if len(held) > 1 and (found := _linked(held, cfg, hasher)):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def _linked_in_buckets(held: DataFrame, reps: DataFrame, texts: DataFrame, cfg: Config, block: int = 300) -> DataFrame:
    """All links between documents of different components (key, id, c) that share a bucket; buckets are compared in pairs of blocks."""
    ids = materialize(held.select("id").distinct(), "ids")
    size = held.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    rows = held.join(size, "key").withColumn("blocks", F.ceil(F.col("m") / F.lit(block)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("lo"), F.greatest(o, F.col("own")).alias("hi"), (F.col("own") > o).cast("int").alias("side")))
    rows = rows.select("key", "id", "c", F.explode(pairs).alias("p")).select("key", "id", "c", F.xxhash64("key", "p.lo", "p.hi").alias("grp"), F.col("p.side").alias("side"))
    full = within_ids(texts, ids, "id").join(within_ids(reps, ids, "id"), "id")
    rows = rows.join(full, "id").withColumn("band", F.array_position("bands", F.col("key")).cast("int") - 1)
    rows = rows.select("grp", "id", "c", "side", "band", "bands", "sketch", "text").repartition("grp").sortWithinPartitions("grp")
    out = materialize(rows.mapInArrow(lean(_bucket_linker(cfg)), "a long, b long").distinct(), "links")
    release(ids)
    return out


def _members(sig: DataFrame, classes: DataFrame, many: int = 1000) -> DataFrame:
    """``id``, ``n`` and the class representative ``rep`` (null for empty sets and null ids) of every row.

    Classes of more than ``many`` copies are broadcast, up to BROADCAST_IDS of
    them, so that no class is dealt to one task; beyond that the join is left
    to be split where it is skewed.
    """
    on = ["d0", "d1", "n"]
    takes_part = F.coalesce((F.col("n") > 0) & F.col("id").isNotNull(), F.lit(False))
    rows, out = sig.filter(takes_part).select("id", *on), ["id", "n", "rep"]
    none = sig.filter(~takes_part).select("id", "n", F.lit(None).cast("long").alias("rep"))
    large = classes.filter(F.col("copies") > many).select(*on, "rep")
    count = large.count()
    if not 0 < count <= BROADCAST_IDS:
        return rows.join(classes, on).select(*out).union(none)
    large, small = F.broadcast(large), classes.filter(F.col("copies") <= many)
    return rows.join(large, on).select(*out).union(rows.join(large, on, "left_anti").join(small, on).select(*out)).union(none)


def near_duplicates(docs: DataFrame, cfg: Config, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group near-duplicate documents.

    Returns one row per input row: ``id_col``, ``n_shingles`` (long),
    ``component_id`` (the smallest id reachable by links, itself included) and
    ``kept`` (the id is the component's). A null, empty or blank text has an
    empty set, links with nothing and is kept. A null id takes no part: its
    component is null and it is kept. Rows that repeat an id are one document:
    all of them are returned, with the links of any. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    sig = materialize(signatures(docs, cfg, id_col, text_col), "signatures")
    real = sig.filter("n > 0 and id is not null")
    classes = materialize(real.groupBy("d0", "d1", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    member = materialize(_members(sig, classes), "members")
    reps = materialize(real.join(classes.select("d0", "d1", "n", F.col("rep").alias("id")), ["d0", "d1", "n", "id"], "left_semi").dropDuplicates(["id", "d0", "d1", "n"]).select("id", "bands", "sketch"), "reps")
    release(sig, classes)
    keys = reps.select("id", F.explode("bands").alias("key"))
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    buckets = materialize(keys.join(counts, "key").select("key", "id", "m"), "buckets")
    # the hub of a bucket: the document whose buckets hold the most others, so that copies altered in different places meet their common source
    weight = buckets.groupBy("id").agg(F.sum("m").alias("w"))
    hubs = buckets.join(weight, "id").groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("neg"))).alias("top")).select("key", (-F.col("top.neg")).alias("hub"))
    first = materialize(buckets.join(hubs, "key").filter("hub <> id").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct(), "pairs")
    links = _confirmed(first, reps, texts, cfg)
    comp = materialize(connected_components(links), "components")
    held = buckets.select("key", "id").join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = held.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    held = materialize(held.join(mixed, "key", "left_semi"), "mixed")
    more = _linked_in_buckets(held, reps, texts, cfg)
    release(comp, held, buckets, reps, first)
    comp = connected_components(links.union(more))
    out = member.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def op7_minhash_odd_sketches(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates of documents: 3-word shingles, Jaccard 0.85 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, for_similarity(3, 85))
