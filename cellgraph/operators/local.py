"""Transfer functions: instruction facts to equations, links, flags, types and sites.

Every pointer value is a node of its own until unification; ``value_node`` gives
its id in a graph. An instruction then only states relations: a cast makes two
values equal, a constant GEP makes them equal at an offset, a load or store
links a field of the address to a value. One fixpoint over all functions turns
them into memory graphs (:mod:`cellgraph.operators.unify`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import field_type, is_byte_pointer, is_pointer
from ..schema import ANY_TYPE, EDB, FLAG

LINK = "graph, node, off, ftype, dst, dst_off"
#: What each specification function does; ``extern`` and ``external`` are one.
SPEC_FLAGS = {"set_modified": "modified", "set_read": "read", "set_heap": "heap", "set_ptrtoint": "ptrtoint", "set_inttoptr": "inttoptr", "set_extern": "external", "set_external": "external"}


def value_node(graph, val):
    """The node of a value in a graph: equal for equal (graph, value), so that reruns agree."""
    return F.xxhash64(graph, F.lit("v"), val)


def fresh_node(graph, val):
    return F.xxhash64(graph, F.lit("fresh"), val)


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A fact table without rows; the planner drops what is derived from it."""
    return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in EDB[name].fields) + " WHERE false")


class Program:
    """The fact tables of a program; tables that are not given are empty."""

    def __init__(self, spark: SparkSession, **tables: DataFrame):
        self.spark = spark
        self.tables = tables

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return empty(self.spark, name)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def facts(p: Program, graph_of: DataFrame, type_aware: bool = True, omni: bool = True) -> dict[str, DataFrame]:
    """eq, link, flag, size, accessed, site, array and collapse facts of all functions.

    ``graph_of`` has (func, graph): functions of one graph share their nodes
    (a component of the call graph, or all of them when context-insensitive).
    """
    g = graph_of.select("func", "graph")
    at = lambda name: p[name].join(g, "func")
    node = lambda v: value_node(F.col("graph"), F.col(v))
    zero = F.lit(0).cast("long")

    def eq(df, a, b, off=zero):
        """Byte 0 of value a is byte ``off`` of value b."""
        return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select("graph", node(a).alias("n1"), zero.alias("o1"), node(b).alias("n2"), off.cast("long").alias("o2"))

    def flag(df, v, *names):
        return df.filter(F.col(v).isNotNull()).select("graph", node(v).alias("node"), F.lit(sum(FLAG[n] for n in names)).alias("flags"))

    def access(df, v, off=zero):
        return df.filter(F.col(v).isNotNull()).select("graph", node(v).alias("node"), off.cast("long").alias("off"), F.col("type"), F.coalesce("bytes", F.lit(1)).cast("long").alias("bytes"))

    def link(df, v, target, off=zero):
        hit = df.filter(F.col(v).isNotNull() & F.col(target).isNotNull() & is_pointer(F.col("type")))
        return hit.select("graph", node(v).alias("node"), off.cast("long").alias("off"), field_type(F.col("type"), type_aware, omni).alias("ftype"), node(target).alias("dst"), zero.alias("dst_off"))

    def site(df, v):
        return df.select("graph", node(v).alias("node"), F.col(v).alias("val"))

    alloca, cast, gep, phi, select = at("i_alloca"), at("i_cast"), at("i_gep"), at("i_phi"), at("i_select")
    load, store, memset, memcpy = at("i_load"), at("i_store"), at("i_memset"), at("i_memcpy")
    insert, extract, i2p, p2i, atomic = at("i_insertval"), at("i_extractval"), at("i_inttoptr"), at("i_ptrtoint"), at("i_atomic")
    formal, spec = at("formal"), at("spec_call")
    main = p["func"].filter("is_main").select("func")
    # a byte pointer that is stored takes the better pointer type that loads and other stores see in the same slot
    better = _union([load, store.select(*load.columns[:0], "func", F.col("val").alias("dst"), "ptr", "type", "bytes", "graph")]).filter(is_pointer(F.col("type")) & ~is_byte_pointer(F.col("type"))).groupBy("graph", "ptr").agg(F.min("type").alias("slot"))
    store = store.join(better, ["graph", "ptr"], "left").withColumn("type", F.when(is_byte_pointer(F.col("type")) & F.col("slot").isNotNull(), F.col("slot")).otherwise(F.col("type"))).drop("slot")
    null = p["value"].filter("kind in ('null', 'undef')").select(F.col("val").alias("src"))
    no_pointer = p["value"].filter("kind in ('null', 'undef') or not is_ptr").select("val")
    # globals and functions are objects wherever an operand names them
    operands = _union([d.select("graph", F.col(c).alias("val")) for d, c in ((load, "ptr"), (store, "ptr"), (store, "val"), (cast, "src"), (gep, "base"), (phi, "src"), (select, "a"), (select, "b"), (memset, "dst"), (memcpy, "dst"), (memcpy, "src"), (atomic, "ptr"), (atomic, "newval"))])
    actual = p["i_actual"].join(p["i_call"].select("cs", "func"), "cs").join(g, "func").select("graph", "val").join(no_pointer, "val", "left_anti").select("graph", "val")
    returned = p["i_ret"].join(g, "func").filter("val is not null").join(no_pointer, "val", "left_anti").select("graph", "val")
    of_main = p["func"].filter("is_main").join(g, "func").select("graph").distinct()
    initial = p["global_init"].withColumn("one", F.lit(1)).join(of_main.withColumn("one", F.lit(1)), "one")  # one main function in a program
    objects = _union([operands, actual, returned, initial.select("graph", F.col("gv").alias("val")), initial.select("graph", F.col("target").alias("val"))]).join(p["value"].filter("kind in ('global', 'func')").select("val"), "val", "left_semi").select("graph", "val").distinct()
    sites_of_calls = p["i_call"].join(p["func"].select(F.col("func").alias("callee"), "is_decl", "alloc_kind", "ret_noalias"), "callee", "left").withColumnRenamed("func", "func")
    every_call = sites_of_calls.join(g, "func")
    calls = every_call.filter("ret_val is not null")
    heap = calls.filter("alloc_kind is not null")
    outside = calls.filter("alloc_kind is null and (coalesce(is_asm, false) or is_decl)")
    const = gep.filter("coalesce(stride, 0) = 0")
    variable = gep.filter("coalesce(stride, 0) <> 0")
    recovered, made = i2p.filter("base is not null"), i2p.filter("base is null")
    fresh = lambda v: fresh_node(F.col("graph"), F.col(v))

    out = {
        "eq": _union([
            eq(cast, "dst", "src"), eq(phi.join(null, "src", "left_anti"), "dst", "src"), eq(select, "dst", "a"), eq(select, "dst", "b"),
            eq(const, "dst", "base", F.col("const_off")), eq(variable, "dst", "base"), eq(insert, "dst", "agg"), eq(recovered, "dst", "base", F.coalesce("off", F.lit(0))),
            eq(memcpy.filter("coalesce(copies_ptr, true)"), "dst", "src"), eq(atomic.filter("kind = 'rmw'"), "dst", "ptr"), eq(atomic.filter("kind = 'cmpxchg'"), "dst", "newval"),
            eq(spec.filter("kind = 'alias'"), "arg0", "arg1"),
        ]).distinct(),
        "link": _union([
            link(load, "ptr", "dst"), link(store, "ptr", "val"), link(insert, "agg", "val", F.col("off")), link(extract, "agg", "dst", F.col("off")), link(atomic.filter("kind = 'cmpxchg'"), "ptr", "dst"),
            link(spec.filter("kind like 'link%'").withColumn("off", F.col("arg1")), "arg0", "arg2", F.col("arg1")),
            initialised(initial, node, "graph"),
        ]).distinct(),
        "flag": _union([
            flag(alloca, "val", "alloca"), flag(load, "ptr", "read"), flag(store, "ptr", "modified"), flag(memset, "dst", "modified"), flag(memcpy, "dst", "modified"), flag(memcpy, "src", "read"),
            flag(insert, "agg", "modified"), flag(extract, "agg", "read"), flag(atomic, "ptr", "modified", "read"), flag(made, "dst", "alloca", "inttoptr"), flag(p2i.filter("escapes"), "src", "ptrtoint"),
            flag(formal, "val", "alloca"), flag(heap, "ret_val", "heap"), flag(outside, "ret_val", "external"), flag(variable, "dst", "array"),
            *[flag(spec.filter(F.col("kind") == k), "arg0", f) for k, f in SPEC_FLAGS.items()],
        ]),
        "accessed": _union([
            access(load, "ptr"), access(store, "ptr"), access(insert, "agg", F.col("off")), access(extract, "agg", F.col("off")), access(atomic, "ptr"),
            access(spec.filter("kind like 'access%'").withColumn("bytes", F.lit(1).cast("long")), "arg0", F.col("arg1")),
        ]).distinct(),
        "site": _union([site(alloca, "val"), site(made, "dst"), site(heap, "ret_val"), site(outside.filter("coalesce(ret_noalias, false) or coalesce(is_asm, false)"), "ret_val"), site(formal.join(main, "func", "left_semi"), "val"), site(objects, "val")]).distinct(),
        "array": _union([variable.select("graph", node("dst").alias("node"), F.col("stride").alias("stride")), spec.filter("kind = 'mk_seq' and arg1 > 0").select("graph", node("arg0").alias("node"), F.col("arg1").alias("stride"))]),
        "collapse": spec.filter("kind = 'collapse'").select("graph", node("arg0").alias("node")),
    }
    scalar = _union([d.select("graph", F.col(c).alias("val")) for d, c in ((alloca, "val"), (cast, "dst"), (gep, "dst"), (phi, "dst"), (select, "dst"), (load.filter(is_pointer(F.col("type"))), "dst"), (store, "ptr"), (load, "ptr"), (memset, "dst"), (memcpy, "dst"), (memcpy, "src"), (i2p, "dst"), (insert, "dst"), (extract.filter("is_ptr"), "dst"), (calls, "ret_val"), (actual, "val"), (store.filter(is_pointer(F.col("type"))), "val"))])
    scalar = scalar.filter("val is not null").join(no_pointer, "val", "left_anti").distinct().select("graph", F.lit("scalar").alias("kind"), "val")
    cell = _union([formal.select("graph", F.lit("formal").alias("kind"), "val"), returned.select("graph", F.lit("ret").alias("kind"), "val"), scalar, objects.select("graph", F.lit("global").alias("kind"), "val")]).distinct()
    cell = cell.select("graph", "kind", "val", value_node(F.col("graph"), F.col("val")).alias("node"), zero.alias("off"))
    # an indirect call is a cell of its own: that of the value called
    indirect = every_call.filter("callee is null and called_val is not null").select("graph", F.lit("callsite").alias("kind"), F.col("cs").alias("val"), node("called_val").alias("node"), zero.alias("off"))
    out["cell"] = cell.union(indirect).distinct()
    return out


def initialised(init: DataFrame, node, *more: str) -> DataFrame:
    """Links that initialisers of globals (gv, off, target) make; ``node`` gives a value's node by its column."""
    return init.select(*more, node("gv").alias("node"), F.col("off").cast("long").alias("off"), F.lit(ANY_TYPE).alias("ftype"), node("target").alias("dst"), F.lit(0).cast("long").alias("dst_off"))


def with_escapes(p: Program) -> Program:
    """The program with ``escapes`` of its pointer-to-integer casts found from the uses of their results (table ``use``)."""
    out = escaping_casts(p["use"]).withColumn("escapes", F.lit(True))
    casts = p["i_ptrtoint"].drop("escapes").join(out, "src", "left").select("func", "src", F.coalesce("escapes", F.lit(False)).alias("escapes"))
    return Program(p.spark, **p.tables | {"i_ptrtoint": casts})


def only_compared(uses: DataFrame) -> DataFrame:
    """Values (val) all of whose uses (src, kind) are comparisons."""
    return uses.groupBy(F.col("src").alias("val")).agg(F.bool_and(F.col("kind") == "cmp").alias("every")).filter("every").select("val")


def indirect_records(calls: DataFrame, cells: DataFrame) -> DataFrame:
    """cs, caller, node, off: indirect calls (cs, caller, called_val) with the cell that they call."""
    return calls.join(cells.select(F.col("val").alias("called_val"), "node", "off"), "called_val").select("cs", "caller", "node", "off")


def resolved(values: DataFrame, most: int = 10_000) -> DataFrame:
    """val, base, off: what each constant expression (val, base, off) stands for, through all that it refers to.

    ``base`` is null for an object. Chains double with every round; cycles raise.
    """
    from .fixpoint import cut

    at = cut(values.select("val", F.coalesce("base", "val").alias("base"), F.when(F.col("base").isNull(), 0).otherwise(F.col("off")).cast("long").alias("off")))
    for _ in range(most):
        jump = at.select(F.col("val").alias("base"), F.col("base").alias("up"), F.col("off").alias("more"))
        new = cut(at.join(jump, "base", "left").select("val", F.coalesce("up", "base").alias("base"), (F.col("off") + F.when(F.col("up") == F.col("base"), 0).otherwise(F.coalesce("more", F.lit(0)))).alias("off"), (F.coalesce("up", "base") != F.col("base")).alias("moved")))
        at = new.drop("moved")
        if new.filter("moved").isEmpty():
            return at
    raise RuntimeError("constant expressions refer to themselves")


def escaping_casts(uses: DataFrame) -> DataFrame:
    """Pointer-to-integer values that flow to a load, store, call or back to a pointer: (src).

    ``uses`` has (src, user, kind); arithmetic and casts are followed, comparisons and branches are not.
    """
    from .fixpoint import reach

    flow = uses.filter("kind in ('cast', 'arith', 'phi')").select("src", F.col("user").alias("dst"))
    reached = reach(uses.filter("kind = 'ptrtoint'").select(F.col("src").alias("tag"), F.col("user").alias("id")), flow)
    sink = uses.filter("kind in ('load', 'store', 'call', 'inttoptr')").select(F.col("src").alias("id")).distinct()
    return reached.join(sink, "id", "left_semi").select(F.col("tag").alias("src")).distinct()
