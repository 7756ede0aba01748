"""Specifications of functions, target layouts, logs."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fixpoint import reach
from ..schema import FLAG

#: What a specification says of a flag: fixed names.
FLAG_KINDS = {"modified": "set_modified", "read": "set_read", "heap": "set_heap", "ptrtoint": "set_ptrtoint", "inttoptr": "set_inttoptr", "external": "set_extern"}
#: Kinds that are known; any other is an external call.
KINDS = ("alias", "collapse", "mk_seq", "mk", *FLAG_KINDS.values(), "set_external")
PREFIXES = ("link", "access")


def chosen(bodies: DataFrame) -> DataFrame:
    """One body for each function of (name, load, body): the first loaded stays."""
    return bodies.groupBy("name").agg(F.min(F.struct("load", "body")).alias("at")).select("name", "at.body")


def substituted(functions: DataFrame, bodies: DataFrame) -> DataFrame:
    """func, body: the specified body where there is one, else the function's own (func, name, body)."""
    spec = chosen(bodies).withColumnRenamed("body", "spec")
    return functions.join(spec, "name", "left").select("func", F.coalesce("spec", "body").alias("body"))


def kind_of(name, prefix: str):
    """The kind of a call to a specification function by its name; 'external' for the ones that are not known, null for other functions."""
    short = F.substring(name, F.lit(len(prefix) + 1), F.length(name))
    kind = F.when(short.isin(*KINDS), short)
    for p in PREFIXES:
        kind = kind.when(short.startswith(p), p)
    return F.when(name.startswith(prefix), kind.otherwise("external"))


def summary_spec(formals: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """func, kind, arg0, arg1, arg2: calls that rebuild a summary graph: flags, collapses, arrays and links of all nodes that the formals (func, node) reach."""
    own = reach(formals.select(F.col("func").alias("tag"), F.col("node").alias("id")), links.select(F.col("node").alias("src"), "dst")).select(F.col("tag").alias("func"), F.col("id").alias("node"))
    none = F.lit(None).cast("long")
    items = links.select("node", "off", "dst").distinct().select("node", F.lit("link").alias("kind"), F.col("off").alias("arg1"), F.col("dst").alias("arg2"))
    # what is said of a node is made distinct before it is repeated for each function
    once = nodes.groupBy("node").agg(F.bit_or("flags").alias("flags"), F.bool_or("collapsed").alias("collapsed"), F.collect_set(F.when(F.col("stride") > 0, F.col("stride").cast("long"))).alias("strides"))
    call = lambda kind, arg1: F.struct(F.lit(kind).alias("kind"), arg1.alias("arg1"))
    said = [F.when(F.col("flags").bitwiseAND(F.lit(FLAG[flag])) != 0, call(kind, none)) for flag, kind in FLAG_KINDS.items()]
    said = F.filter(F.array(*said, F.when(F.col("collapsed"), call("collapse", none))), lambda x: x.isNotNull())
    of_nodes = once.select("node", F.explode(F.concat(said, F.transform("strides", lambda s: call("mk_seq", s)))).alias("x")).select("node", "x.kind", "x.arg1", none.alias("arg2"))
    return own.join(items.union(of_nodes), "node").select("func", "kind", F.col("node").alias("arg0"), "arg1", "arg2")


def pointer_bytes(layout):
    """Bytes of a pointer in a target layout (``p:32:32``; 8 where it says nothing)."""
    bits = F.regexp_extract(layout, r"(?:^|-)p(?:0)?:([0-9]+)", 1)
    return F.when(bits == "", 8).otherwise((bits.cast("int") / 8).cast("int"))


def log(tag: str) -> logging.Logger:
    """The logger of a tag; ``log("dsa-bu").setLevel(...)`` turns one on."""
    return logging.getLogger(f"cellgraph.{tag}")
