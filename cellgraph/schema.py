"""Fact tables of a program and the flags of memory nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The letter that reports print for each flag, in their order; the position is the bit.
FLAG_LETTERS = (
    ("array", "Sequence "),
    ("alloca", "S"),
    ("heap", "H"),
    ("global", "G"),
    ("unknown", "U"),
    ("incomplete", "I"),
    ("modified", "M"),
    ("read", "R"),
    ("external", "E"),
    ("extern_func", "X"),
    ("extern_global", "Y"),
    ("inttoptr", "P"),
    ("ptrtoint", "2"),
    ("vastart", "V"),
    ("dead", "D"),
    ("null", "N"),
    ("foreign", ""),
)
FLAG = {name: 1 << i for i, (name, _) in enumerate(FLAG_LETTERS)}
ANY_TYPE, OMNI = "?", "omni"


def _table(spec: str) -> T.StructType:
    kinds = {"": T.LongType(), "s": T.StringType(), "b": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k], True) for n, _, k in (c.partition(":") for c in spec.split())])


#: One table for each kind of fact; columns are long unless marked s (string) or b (boolean).
EDB = {
    "func": _table("func name:s is_decl:b is_main:b ret_is_ptr:b ret_noalias:b alloc_kind:s type:s program"),
    "value": _table("val func kind:s name:s type:s is_ptr:b"),
    "type_leaf": _table("type:s idx off leaf:s bytes is_ptr:b"),
    "i_alloca": _table("func val"),
    "i_cast": _table("func dst src"),
    "i_gep": _table("func dst base const_off stride"),
    "i_phi": _table("func dst src"),
    "i_select": _table("func dst a b"),
    "i_load": _table("func dst ptr type:s bytes"),
    "i_store": _table("func ptr val type:s bytes"),
    "i_memset": _table("func dst"),
    "i_memcpy": _table("func dst src copies_ptr:b"),
    "i_insertval": _table("func dst agg val off type:s bytes"),
    "i_extractval": _table("func dst agg off type:s bytes is_ptr:b"),
    "i_inttoptr": _table("func dst base off"),
    "i_ptrtoint": _table("func src escapes:b"),
    "i_atomic": _table("func kind:s dst ptr newval type:s bytes"),
    "i_ret": _table("func val"),
    "i_call": _table("cs func callee called_val ret_val is_asm:b type:s"),
    "i_actual": _table("cs idx val"),
    "formal": _table("func idx val"),
    "global_init": _table("gv off target"),
    "use": _table("src user kind:s"),
    "spec_call": _table("cs func kind:s arg0 arg1 arg2 type:s"),
}


def flag_letters(flags: Column) -> Column:
    """The letters of the flags that are set, in report order."""
    return F.concat(*[F.when(flags.bitwiseAND(F.lit(1 << i)) != 0, F.lit(letter)).otherwise("") for i, (_, letter) in enumerate(FLAG_LETTERS) if letter])


def join_flags(flags: Column, collapsed: Column) -> Column:
    """Aggregate: flags are joined by OR, foreign by AND; a collapsed node is no array."""
    rest = F.bit_or(flags.bitwiseAND(F.lit(~FLAG["foreign"])))
    merged = rest.bitwiseOR(F.bit_and(flags.bitwiseAND(F.lit(FLAG["foreign"]))))
    return F.when(collapsed, merged.bitwiseAND(F.lit(~FLAG["array"]))).otherwise(merged)
