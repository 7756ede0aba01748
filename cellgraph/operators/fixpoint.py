"""Driver loops that reach a fixpoint: lineage cuts, components, reachability.

Every round is written as Parquet into the folder that ``spark.checkpoint.dir``
names (or one of our own where it is unset) and read again. That survives lost
executors, keeps plans short and gives the planner true sizes.
"""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import this package


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; one of our own only where a local session names none."""
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


#: Graphs of at most so many rows (counted first) are solved in one task; larger ones component by component, and single components above it in a distributed loop.
SMALL = 1_000_000
#: Rows of whole components that one task of many takes together, about.
BIN = 500_000
#: Tables of at most so many rows (counted first) are sent to all tasks of a join.
FEW = 100_000
#: Marks (one for each pair of a source and a node of its component) that a closure holds at once.
CELLS = 4_000_000


def in_one_task(rows: DataFrame, solve, schema: str) -> DataFrame:
    """Apply ``solve`` (an Arrow table to dict of arrays) to all rows in one task; only for tables of a counted, small size."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    types = {"long": pa.int64(), "boolean": pa.bool_()}
    kinds = [types[c.strip().split(" ")[1]] for c in schema.split(",")]

    def run(table):
        found = solve({c: table.column(c).to_numpy(zero_copy_only=False) for c in table.column_names if c != "one"})
        return pa.table([pa.array(a, k) for a, k in zip(found, kinds)], names)

    return rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, schema)


def in_parts(rows: DataFrame, run, schema: str, key: str | None = None, size: int = BIN, held: int | None = None) -> DataFrame:
    """``run`` (Arrow batches to batches) over all rows in one task, or, with a ``key``, over bins of about ``size`` rows that hold all rows of each of their keys; ``held`` is the number of rows where it is known."""
    n = 1 if key is None else max(1, -(-(rows.count() if held is None else held) // size))
    return (rows.repartition(1) if key is None else rows.repartition(n, key).drop(key)).mapInArrow(run, schema)


def columns_of(batches) -> dict[str, np.ndarray]:
    """Arrow batches as one array for each column."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return {}
    table = pa.Table.from_batches(held)
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the least id of their component, by hooking and pointer jumping."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    lab = np.arange(len(ids))
    while len(x):
        p, q = lab[x], lab[y]
        low = np.minimum(p, q)
        new = lab.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        lab = new
        open_ = lab[x] != lab[y]
        x, y = x[open_], y[open_]
    return ids, ids[lab]


def cut_folder(spark: SparkSession) -> str:
    """A fresh folder name in the shared folder."""
    return f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage."""
    path = cut_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def appended(df: DataFrame, folder: str) -> DataFrame:
    """Append ``df`` to the folder and read all that it then holds; nothing that is there is written again."""
    df.write.mode("append").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ranked(df: DataFrame, *columns: str, parts: int = 64, name: str = "rank") -> DataFrame:
    """Rows with their place from 1 in the order of the columns: range partitions number their own rows, and the counts of those before are added.

    ``columns`` must tell all rows apart, or ties fall in any order.
    """
    rows = cut(df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns).withColumn("__part", F.spark_partition_id()))
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row for each range
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*columns))
    return rows.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + place).cast("long")).drop("__part", "__before")


def _label_batches(batches):
    t = columns_of(batches)
    if t:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _least_labels(t["a"], t["b"])], ["id", "rep"])


def components(edges: DataFrame, max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """id, rep (the smallest id reachable) for every end of the undirected edges (a, b).

    Large graphs (counted first) are cut into ranges of ids, each range is
    labelled by itself, and the ranges' labels that meet at some id are the
    edges of a smaller graph with the same components. Loops make their end a
    component; null ends are ignored.
    """
    ends = edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    ends = cut(ends)
    n = ends.count()
    if n <= small:
        return in_one_task(ends, lambda t: _least_labels(t["a"], t["b"]), "id long, rep long")
    local = cut(ends.repartitionByRange(max(2, -(-n // BIN)), "b").mapInArrow(_label_batches, "id long, rep long"))
    least = cut(local.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")))
    met = local.join(least.filter("low <> high").select("id", "low"), "id").filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    met = cut(met)
    few = met.count() <= small
    merged = cut(in_one_task(met, lambda t: _least_labels(t["a"], t["b"]), "id long, rep long") if few else _stars(met, max_rounds))
    return least.select("id", "low").join(merged.withColumnRenamed("id", "low"), "low", "left").select("id", F.coalesce("rep", "low").alias("rep"))


def _stars(e: DataFrame, max_rounds: int) -> DataFrame:
    """Components of edges with a > b by alternating large-star and small-star rounds: O(log n) of them in practice."""
    mark = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1_000_003))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixpoint in {max_rounds} rounds")
    tree = e.groupBy("a").agg(F.min("b").alias("rep")).withColumnRenamed("a", "id")
    roots = tree.select(F.col("rep").alias("id"), "rep").distinct()
    return tree.union(roots)


def split_by_component(rows: DataFrame, lab: DataFrame, small: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with the component ``rep`` of their ``node`` (the node itself where ``lab`` has none): those of components of at most ``small`` rows, and the others (None if there are none)."""
    at = cut(rows.join(lab.withColumnRenamed("id", "node"), "node", "left").withColumn("rep", F.coalesce("rep", "node")))
    big = cut(at.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > small).select("rep"))
    if big.isEmpty():
        return at, None
    return at.join(big, "rep", "left_anti"), at.join(big, "rep", "left_semi")


def _ends(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The lesser and the greater end of rows: those of kind 2 tie x and y together, others are at y alone."""
    x = np.where(t["kind"] == 2, t["x"], t["y"])
    return np.minimum(x, t["y"]), np.maximum(x, t["y"])


def _range_batches(batches):
    """Each different row once, with the least id of its component in this range, and whether its lesser end lies below the range."""
    t = columns_of(batches)
    if not t:
        return
    order = np.lexsort(list(t.values()))
    t = {c: v[order] for c, v in t.items()}
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([v[1:] != v[:-1] for v in t.values()], axis=0)
    t = {c: v[fresh] for c, v in t.items()}
    a, b = _ends(t)
    ids, lab = _least_labels(a, b)
    t |= {"lab": lab[np.searchsorted(ids, b)], "out": a < b.min()}
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in t.values()], list(t))


def by_component(rows: DataFrame, small: int, max_rounds: int = 60) -> tuple[DataFrame, DataFrame | None]:
    """Rows of longs (x, y, kind and others), each once, with the component ``rep`` of their ends (:func:`_ends`): those of components of at most ``small`` rows, and the others (None if there are none).

    Ranges of the greater end are labelled by themselves. Only ends that lie
    below their range can have labels of two ranges, so only these are compared.
    """
    ranges = max(2, -(-rows.count() // BIN))
    x = F.when(F.col("kind") == 2, F.col("x")).otherwise(F.col("y"))
    low, high = F.least(x, "y"), F.greatest(x, "y")
    schema = ", ".join(f"{c} long" for c in rows.columns) + ", lab long, out boolean"
    local = cut(rows.repartitionByRange(ranges, high).mapInArrow(_range_batches, schema))
    far = cut(local.filter("out").select(low.alias("id"), "lab").distinct())
    few = F.broadcast if far.count() <= FEW else lambda df: df
    ends = local.select(high.alias("id"), "lab").union(local.filter("not out").select(low, "lab"))
    near = ends.join(few(far.select("id").distinct()), "id", "left_semi").distinct()
    met = cut(far.union(near).filter("id <> lab").select(F.greatest("id", "lab").alias("a"), F.least("id", "lab").alias("b")).distinct())
    merged = cut(in_one_task(met, lambda t: _least_labels(t["a"], t["b"]), "id long, rep long") if met.count() <= small else _stars(met, max_rounds))
    at = local.drop("out").join(few(merged.withColumnRenamed("id", "lab")), "lab", "left").withColumn("rep", F.coalesce("rep", "lab")).drop("lab")
    big = cut(at.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > small).select("rep"))
    if big.isEmpty():
        return at, None
    return at.join(big, "rep", "left_anti"), at.join(big, "rep", "left_semi")


def _closure(source: np.ndarray, ids: np.ndarray, turn: np.ndarray, src: np.ndarray, dst: np.ndarray):
    """Yields (source, id, turn) arrays of the closure: breadth first, for many sources at once, with a mark for each node of a source's component.

    Seeds of turn 1 start when those of turn 0 of their source are done, and find only what these have left.
    """
    nodes, code = np.unique(np.concatenate([ids, src, dst]), return_inverse=True)
    at, s, d = code[: len(ids)], code[len(ids) : len(ids) + len(src)], code[len(ids) + len(src) :]
    del code
    every = np.arange(len(nodes))
    comp = _least_labels(np.concatenate([every, s]), np.concatenate([every, d]))[1]
    order = np.argsort(comp, kind="stable")  # nodes of one component stand together
    place = np.empty_like(order)
    place[order] = every
    nodes, comp = nodes[order], comp[order]
    at, s, d = place[at], place[s], place[d]
    by = np.argsort(s, kind="stable")
    target, lo = d[by], np.searchsorted(s[by], np.arange(len(nodes) + 1), "left")
    first = np.searchsorted(comp, comp, "left")  # of each node's component
    width = np.searchsorted(comp, comp, "right") - first
    # a row of marks for each source and component that it starts in
    order = np.lexsort((source, first[at]))
    source, at, turn = source[order], at[order], turn[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (source[1:] != source[:-1]) | (first[at][1:] != first[at][:-1])
    row = np.cumsum(fresh) - 1
    starts, sizes, names = first[at][fresh], width[at][fresh], source[fresh]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < len(names):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CELLS, "right")) - 1)
        base = bounds[i:j] - bounds[i]
        marks = bytearray(int(bounds[j] - bounds[i]))
        known = np.frombuffer(marks, np.uint8)
        slot = np.empty(len(known), np.int32)
        a, b = np.searchsorted(row, [i, j], "left")
        for now in (1, 2):
            mine = np.flatnonzero(turn[a:b] == now - 1) + a
            k = row[mine] - i
            shift = starts[row[mine]] - base[k]  # from a mark to its node
            front = at[mine] - shift
            while True:
                left = known[front] == 0
                front, shift = front[left], shift[left]
                slot[front] = np.arange(len(front), dtype=np.int32)
                once = slot[front] == np.arange(len(front), dtype=np.int32)
                front, shift = front[once], shift[once]
                known[front] = now
                while 0 < len(front) < 16:  # long thin graphs: no arrays for a handful of nodes
                    new, by_ = [], []
                    for f, h in zip(front.tolist(), shift.tolist()):
                        for t in target[lo[f + h] : lo[f + h + 1]].tolist():
                            if not marks[t - h]:
                                marks[t - h] = now
                                new.append(t - h)
                                by_.append(h)
                    front, shift = np.array(new, np.int64), np.array(by_, np.int64)
                if not len(front):
                    break
                v = front + shift
                size = lo[v + 1] - lo[v]
                pick = np.repeat(lo[v] - np.cumsum(size) + size, size) + np.arange(size.sum())
                shift = np.repeat(shift, size)
                front = target[pick] - shift
        found = np.flatnonzero(known)
        k = np.repeat(np.arange(j - i), np.diff(np.searchsorted(found, np.append(base, len(known)), "left")))
        yield names[i + k], nodes[found + (starts[i:j] - base)[k]], known[found] - np.uint8(1)
        i = j


def _closure_batches(batches):
    t = columns_of(batches)
    if not t:
        return
    edge = t["kind"] == 2
    for found in _closure(t["x"][~edge], t["y"][~edge], t["kind"][~edge], t["x"][edge], t["y"][edge]):
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["code", "id", "turn"])


def reach(seeds: DataFrame, edges: DataFrame, max_rounds: int = 100_000, small: int = SMALL, then: DataFrame | None = None) -> DataFrame:
    """Semi-naive closure. ``seeds`` has (tag, id), ``edges`` (src, dst); gives all (tag, id), seeds included.

    Where the edges and the seeds are few (counted first) and ids are longs, one
    task computes it. For more of them the graph is cut into its weak components,
    many tasks take some of these each, and only components that are too large
    for a task take a loop of joins over the newly reached. The result is not
    written: who reads it twice should cut it.

    With ``then``, seeds of a second turn, the result is (tag, id, turn): turn 0
    for what ``seeds`` reach, turn 1 for what only ``then`` reaches.
    """
    turns = seeds.select("tag", "id", F.lit(0).cast("long").alias("kind"))
    if then is not None:
        turns = turns.union(then.select("tag", "id", F.lit(1).cast("long")))
    wanted = ["tag", "id"] if then is None else ["tag", "id", "turn"]
    if seeds.schema["id"].dataType.simpleString() != "bigint":
        return _reach_turns(cut(turns.distinct()), cut(edges.select("src", "dst").distinct()), max_rounds).select(*wanted)
    codes = None
    if seeds.schema["tag"].dataType.simpleString() != "bigint":
        turns = cut(turns.distinct())
        codes = cut(ranked(turns.select("tag").distinct(), "tag", parts=4, name="code"))
        coded = turns.join(codes, "tag")
    else:
        coded = turns.withColumnRenamed("tag", "code").filter("code is not null")
    rows = coded.select(F.col("code").alias("x"), F.col("id").alias("y"), "kind").union(edges.select("src", "dst", F.lit(2).cast("long")))
    rows, rest = cut(rows), None
    schema = "code long, id long, turn long"
    if rows.count() <= small:
        found = in_parts(rows, _closure_batches, schema)
    else:
        fit, rest = by_component(rows, small)
        found = in_parts(fit, _closure_batches, schema, "rep", BIN // 2, rows.count())
    if rest is not None:
        rest = cut(rest)
        again = _reach_turns(rest.filter("kind < 2").select(F.col("x").alias("tag"), F.col("y").alias("id"), "kind"), rest.filter("kind = 2").select(F.col("x").alias("src"), F.col("y").alias("dst")), max_rounds)
        found = found.union(again.select(F.col("tag").alias("code"), "id", "turn"))
    return (found.withColumnRenamed("code", "tag") if codes is None else found.join(codes, "code")).select(*wanted)


def _reach_turns(turns: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """(tag, id, turn) by loops of joins, from seeds (tag, id, kind)."""
    first, then = turns.filter("kind = 0").select("tag", "id"), cut(turns.filter("kind = 1").select("tag", "id"))
    found = _reach_loop(cut(first), edges, max_rounds)
    out = found.withColumn("turn", F.lit(0).cast("long"))
    if then.isEmpty():
        return out
    return out.union(_reach_loop(then, edges, max_rounds).join(found, ["tag", "id"], "left_anti").withColumn("turn", F.lit(1).cast("long")))


def _reach_loop(known: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    fresh, folder = known, cut_folder(known.sparkSession)
    known = appended(known, folder)
    for _ in range(max_rounds):
        step = fresh.join(edges, F.col("id") == F.col("src")).select("tag", F.col("dst").alias("id")).distinct()
        fresh = cut(step.join(known, ["tag", "id"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = appended(fresh, folder)
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def _least_of_each(hi: np.ndarray, lo: np.ndarray, gap: np.ndarray, n: int) -> tuple:
    """Each hi once, with the least (lo, gap) of it; hi and lo are from 0 and below n."""
    base = int(gap.min())
    wide = int(gap.max()) - base + 1
    if n * n * wide < 2**63:  # a sort of numbers is much faster than one of rows
        key = np.sort((hi * n + lo) * wide + (gap - base))
        hi = key // (n * wide)
        fresh = np.append(True, hi[1:] != hi[:-1])
        hi, key = hi[fresh], key[fresh]
        key -= hi * (n * wide)
        lo = key // wide
        return hi, lo, key - lo * wide + base
    order = np.lexsort((gap, lo, hi))
    order = order[np.append(True, hi[order][1:] != hi[order][:-1])]
    return hi[order], lo[order], gap[order]


def _weighted_labels(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple:
    """node, least node of its class, offset from the lowest, conflict: trees of least roots that carry offsets."""
    ids, at = np.unique(np.concatenate([nodes, a, b]), return_inverse=True)
    up, off, bad = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    i, j = at[len(nodes) : len(nodes) + len(a)], at[len(nodes) + len(a) :]
    x, y, d = i, j, w  # position of y is position of x plus d
    while True:
        r, s, gap = up[x], up[y], off[x] + d - off[y]
        apart = r != s
        if not apart.any():
            break
        x, y, d, r, s, gap = (v[apart] for v in (x, y, d, r, s, gap))
        lo, hi, gap = np.minimum(r, s), np.maximum(r, s), np.where(r < s, gap, -gap)
        hi, lo, gap = _least_of_each(hi, lo, gap, len(ids))  # what a class with conflicts says does not hang on the order of rows
        up[hi], off[hi] = lo, gap
        while True:
            top = up[up]
            if (top == up).all():
                break
            up, off = top, off + off[up]
    bad[up[i[off[i] + w != off[j]]]] = True
    low = np.zeros(len(ids), np.int64)
    np.minimum.at(low, up, off)
    return ids, ids[up], off - low[up], bad[up]


def weighted_components(nodes: DataFrame, eq: DataFrame, max_rounds: int = 100, small: int = SMALL) -> DataFrame:
    """Classes of nodes with relative offsets.

    ``eq(n1, o1, n2, o2)`` says that byte o1 of n1 is byte o2 of n2. Returns
    ``node, rep, delta, conflict``: byte x of the node is byte x + delta of the
    class ``rep`` (the smallest node id), all deltas are >= 0 with least 0, and
    ``conflict`` (equal over a class) tells that two offsets were derivable for
    one node. Nodes without equations are classes of their own; an equation in
    which something is null says nothing.

    Large graphs (counted first) are solved within ranges of the greater ends.
    Only components with an id that two ranges have are solved again, whole.
    """
    w = F.col("o1") - F.col("o2")
    told = eq.select(F.col("n1").alias("x"), F.col("n2").alias("y"), w.alias("w")).dropna()
    rows = cut(nodes.select(F.col("node").alias("x"), F.col("node").alias("y"), F.lit(0).cast("long").alias("w")).dropna().union(told))  # a node is what it is
    schema = "node long, rep long, delta long, conflict boolean"
    held = rows.count()
    if held <= small:
        return in_parts(rows, _weighted_batches, schema)
    local = cut(rows.repartitionByRange(max(2, -(-held // BIN)), F.greatest("x", "y")).mapInArrow(_weighted_range_batches, schema))
    found = local.filter("conflict is not null")
    shared = cut(_in_two_ranges(local.filter("conflict is null").select(F.col("node").alias("word"), F.col("rep").alias("bits"))))
    open_ = cut(found.join(_few(shared), "node", "left_semi").select("rep").distinct())
    if open_.isEmpty():
        return found
    open_few = _few(open_)
    ends = cut(found.join(open_few, "rep", "left_semi").select(F.col("node").alias("y")).distinct())
    again = _weighted_classes(cut(rows.join(_few(ends, small), "y", "left_semi").select("x", "y", "w")), schema, max_rounds, small)
    return found.join(open_few, "rep", "left_anti").select("node", "rep", "delta", "conflict").union(again)


def _few(df: DataFrame, limit: int = FEW) -> DataFrame:
    """The table, marked to be sent to all tasks of a join if it has (counted) at most so many rows."""
    return F.broadcast(df) if df.count() <= limit else df


def _in_two_ranges(words: DataFrame) -> DataFrame:
    """node: the ids that are in more than one of the (word, bits); each range gives a word of 64 neighbouring ids once, with a bit for each id it has."""
    none = F.lit(0).cast("long")
    step = lambda s, m: F.struct(s["one"].bitwiseOR(m).alias("one"), s["two"].bitwiseOR(s["one"].bitwiseAND(m)).alias("two"))
    two = F.aggregate("all", F.struct(none.alias("one"), none.alias("two")), step)["two"]
    met = words.groupBy("word").agg(F.collect_list("bits").alias("all")).filter(F.size("all") > 1).select("word", two.alias("two")).filter("two <> 0")
    return met.select("word", F.explode(F.expr("filter(sequence(0, 63), b -> getbit(two, b) = 1)")).alias("bit")).select((F.col("word") * 64 + F.col("bit")).alias("node"))


def _weighted_classes(rows: DataFrame, schema: str, max_rounds: int, small: int) -> DataFrame:
    """The classes of rows whose components lie in several ranges: in one task, or by whole components, too large ones in the loop."""
    held = rows.count()
    if held <= small:
        return in_parts(rows, _weighted_batches, schema)
    fit, rest = by_component(rows.withColumn("kind", F.lit(2).cast("long")), small)
    found = in_parts(fit, _weighted_batches, schema, "rep", held=held)
    if rest is None:
        return found
    e = cut(rest)
    edges = cut(e.select(F.col("x").alias("s"), F.col("y").alias("t"), "w").union(e.select(F.col("y").alias("s"), F.col("x").alias("t"), (-F.col("w")).alias("w"))).distinct())
    ends = edges.select(F.col("s").alias("node")).distinct()
    return found.union(_weighted_loop(ends, edges, max_rounds))


def _weighted_range_batches(batches):
    """The classes of the rows of one range as if there were no others, and its ids as words of 64 of them (node: the word, rep: the bits; conflict is null)."""
    for found in _weighted_batches(batches):
        yield found
        ids = found.column("node").to_numpy()
        word, first = np.unique(ids >> 6, return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (ids & 63).astype(np.uint64), first).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits), pa.array(np.zeros(len(word), np.int64)), pa.nulls(len(word), pa.bool_())], found.schema.names)


def _weighted_batches(batches):
    t = columns_of(batches)
    if t:
        found = _weighted_labels(t["x"][:0], t["x"], t["y"], t["w"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "rep", "delta", "conflict"])


def _weighted_loop(nodes: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """The classes by joins: the least node and the offset from it spread over the edges (s, t, w), both directions."""
    lab = cut(nodes.select(F.col("node").alias("node"), F.col("node").alias("rep"), F.lit(0).cast("long").alias("delta")).distinct())
    for _ in range(max_rounds):
        offer = lab.join(edges, F.col("node") == F.col("s")).select(F.col("t").alias("node"), "rep", (F.col("delta") + F.col("w")).alias("delta"))
        best = lab.select("node", "rep", "delta").union(offer).groupBy("node").agg(F.min(F.struct("rep", "delta")).alias("x")).select("node", "x.rep", "x.delta")
        jump = best.select(F.col("node").alias("rep"), F.col("rep").alias("rep2"), F.col("delta").alias("delta2"))
        new = best.join(jump, "rep").select("node", F.col("rep2").alias("rep"), (F.col("delta") + F.col("delta2")).alias("delta"))
        new = cut(new)
        moved = new.join(lab.withColumnsRenamed({"rep": "old", "delta": "was"}), "node").filter("rep <> old").isEmpty()
        lab = new
        if moved:
            break
    else:
        raise RuntimeError(f"no fixpoint in {max_rounds} rounds")
    other = lab.select(F.col("node").alias("t"), F.col("delta").alias("dt"))
    bad = lab.join(edges, F.col("node") == F.col("s")).join(other, "t").filter(F.col("delta") + F.col("w") != F.col("dt")).select("rep").distinct().withColumn("conflict", F.lit(True))
    low = lab.groupBy("rep").agg(F.min("delta").alias("low"))
    out = lab.join(low, "rep").join(bad, "rep", "left")
    return out.select("node", "rep", (F.col("delta") - F.col("low")).alias("delta"), F.coalesce("conflict", F.lit(False)).alias("conflict"))
