"""Program-shaped facts derived from the star-schema tables, and the same facts as SQL.

All rows of the tables take part. Eight consecutive order keys make one function
body: its orders are pointers, and it has sixteen memory objects of its own,
which the line items of its orders point to. The seventh line of an order points
to an object of the next body, so that classes run over chains of bodies. Line
items are also the calls between suppliers, which are functions in groups of
five that call each other and the groups below. Pointer nodes have even and
object nodes odd ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FLAG

R, M, H = FLAG["read"], FLAG["modified"], FLAG["heap"]
BODY = "CAST(floor(l_orderkey / 8) AS BIGINT)"
PTR, OBJ = "l_orderkey * 2", f"(({BODY} + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) * 16 + l_partkey % 16) * 2 + 1"
FLAGS = f"(CASE WHEN l_linestatus = 'O' THEN {R} ELSE 0 END) | (CASE WHEN l_returnflag = 'R' THEN {M} ELSE 0 END) | (CASE WHEN l_discount > 0.05 THEN {H} ELSE 0 END)"

#: Each fact is one statement that Spark and DuckDB both run; later ones use earlier ones.
FACTS = {
    "points_to": f"SELECT DISTINCT {PTR} AS ptr, {OBJ} AS obj FROM lineitem",
    "vertex": "SELECT DISTINCT ptr AS node FROM points_to UNION SELECT DISTINCT obj AS node FROM points_to",
    "raw_flag": f"SELECT {OBJ} AS node, {FLAGS} AS flags, CAST(8 * l_linenumber + 8 AS BIGINT) AS size FROM lineitem",
    "node": "SELECT node, bit_or(flags) AS flags, max(size) AS size FROM raw_flag GROUP BY node",
    "field": f"SELECT DISTINCT {PTR} AS node, CAST(8 * (l_linenumber % 3) AS BIGINT) AS off, {OBJ} AS dst, CAST(l_suppkey % 2 * 8 AS BIGINT) AS dst_off FROM lineitem",
    "link": f"SELECT {PTR} AS node, CAST(8 * (l_linenumber % 3) AS BIGINT) AS off, {OBJ} AS dst, CAST(l_suppkey % 2 * 8 AS BIGINT) AS dst_off FROM lineitem",
    "half_link": f"SELECT {PTR} AS node, {OBJ} AS dst FROM lineitem WHERE l_orderkey IS NULL OR l_partkey IS NULL OR l_suppkey IS NULL OR l_linenumber IS NULL",
    "typed_field": f"SELECT DISTINCT {PTR} AS node, CAST(8 * (l_linenumber % 3) AS BIGINT) AS off, CASE WHEN p_size % 5 = 0 THEN 'omni' ELSE p_brand END AS ftype, {OBJ} AS dst, CAST(l_suppkey % 2 * 8 AS BIGINT) AS dst_off FROM lineitem JOIN part ON l_partkey = p_partkey",
    "site": f"SELECT DISTINCT {OBJ} AS node, p_partkey AS val, concat(p_brand, '#', CAST(p_partkey AS VARCHAR(20))) AS name, p_type AS type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N'",
    "accessed": f"SELECT DISTINCT {OBJ} AS node, CAST(8 * l_linenumber AS BIGINT) AS off, p_type AS type, CAST(1 + p_size % 8 AS BIGINT) AS bytes FROM lineitem JOIN part ON l_partkey = p_partkey",
    "func": "SELECT s_suppkey AS func, s_name AS name, CAST(s_nationkey % 4 AS BIGINT) AS signature FROM supplier",
    "fcount": "SELECT min(func) AS low, max(func) AS high FROM func",
    "call": "SELECT l_orderkey * 8 + l_linenumber AS cs, l_suppkey AS caller, least(high, greatest(low, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey - l_suppkey % 5 + l_partkey % 5 ELSE l_suppkey - 5 - l_partkey % 40 END)) AS callee, l_discount < 0.06 AS direct, l_tax > 0.07 AS is_asm FROM lineitem , fcount",
    "downcall": "SELECT cs, caller, callee FROM call WHERE floor(caller / 5) > floor(callee / 5)",
    "held": f"SELECT DISTINCT {OBJ} AS node, l_suppkey AS callee FROM lineitem",
    "indirect": f"SELECT l_orderkey * 8 + l_linenumber AS cs, l_suppkey AS caller, {OBJ} AS node, CAST(l_partkey % 4 AS BIGINT) AS signature FROM lineitem WHERE NOT (l_discount < 0.06)",
    "argument_root": f"SELECT DISTINCT {BODY} AS body, {OBJ} AS node FROM lineitem WHERE l_linenumber = 1",
    "return_root": f"SELECT DISTINCT {BODY} AS body, {OBJ} AS node FROM lineitem WHERE l_linenumber = 2",
    "access_log": "SELECT user_id AS node, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS n FROM events",
    "access_total": "SELECT node, CAST(sum(n) AS BIGINT) AS accesses FROM access_log GROUP BY node",
    "cell": "SELECT DISTINCT ptr AS val, obj AS node, CAST(0 AS BIGINT) AS off FROM points_to",
    "object_link": f"SELECT DISTINCT {OBJ} AS node, CAST(8 * (l_linenumber % 4) AS BIGINT) AS off, ({BODY} * 16 + (l_partkey * 3 + l_suppkey) % 16) * 2 + 1 AS dst, CAST(0 AS BIGINT) AS dst_off FROM lineitem",
    "unwritten": f"SELECT node FROM node WHERE (flags & {M}) = 0",
    # instructions: one for each line of an order, in the order of its lines; a body is a function of up to eight orders
    "raw_line": f"SELECT l_orderkey AS ord, CAST(l_linenumber AS BIGINT) AS val, {BODY} AS body, min(l_partkey) AS part, min(l_suppkey) AS func, max(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY l_orderkey, l_linenumber, {BODY}",
    "line": "SELECT ord * 8 + val AS inst, ord, val, body, part, func, flag, status, ((body + CASE WHEN val = 7 THEN 1 ELSE 0 END) * 16 + part % 16) * 2 + 1 AS node, 8 * val AS off, 1 + func % 16 AS bytes FROM raw_line",
    "chain": "SELECT inst, ord, val, body, part, func, flag, status, node, off, bytes, lag(inst) OVER (PARTITION BY ord ORDER BY val) AS prev FROM line",
    "tleaf": "SELECT DISTINCT p_type AS type, CAST(p_size % 4 AS BIGINT) AS idx, CAST(8 * (p_size % 4) AS BIGINT) AS off, CASE WHEN p_size % 4 = 3 THEN 'i8*' ELSE concat('i', CAST(8 * (1 + p_size % 4) AS VARCHAR(5))) END AS leaf, CAST(1 + p_size % 4 AS BIGINT) AS bytes FROM part",
    "uniq_link": "SELECT node, off, ftype, min(dst) AS dst, min(dst_off) AS dst_off FROM typed_field GROUP BY node, off, ftype",
    "new_link": "SELECT node, off, ftype, max(dst) AS dst, CAST(4 AS BIGINT) AS dst_off FROM typed_field WHERE ftype = 'omni' GROUP BY node, off, ftype",
    "edge": "SELECT DISTINCT ord AS src, CAST(body * 8 + part % 8 AS BIGINT) AS dst, body FROM line UNION SELECT ord AS src, ord + 1 AS dst, body FROM line WHERE (ord + 1) % 8 <> 0",
}
TABLES = ("supplier", "part", "orders", "lineitem", "events", "nation", "customer", "region")


def needed(names: tuple[str, ...]) -> list[str]:
    """The facts to define for these, in order."""
    import re

    want, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name in FACTS and name not in want:
            want.add(name)
            todo += [w for w in re.findall(r"\w+", FACTS[name]) if w in FACTS]
    return [n for n in FACTS if n in want]


def with_clause(*names: str, recursive: bool = False) -> str:
    """A WITH clause for DuckDB that defines the facts."""
    return "WITH " + "RECURSIVE " * recursive + ", ".join(f"{n} AS ({FACTS[n]})" for n in needed(names))


class Facts:
    """The facts over one folder of tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in FACTS:
            return self.table(name)
        names = needed((name,))
        used = [t for t in TABLES if any(t in FACTS[n].split() or f"{t}," in FACTS[n] for n in names)]
        return self.spark.sql(with_clause(name) + f" SELECT * FROM {name}", **{}) if not used else self._sql(name, used)

    def _sql(self, name: str, used: list[str]) -> DataFrame:
        # tables are inlined by path, so that no session-wide view is left behind
        sql = with_clause(name) + f" SELECT * FROM {name}"
        tables = ", ".join(f"{t} AS (SELECT * FROM parquet.`{self.sf_dir}/{t}.parquet`)" for t in used)
        return self.spark.sql(sql.replace("WITH ", f"WITH {tables}, ", 1))


def columns(df: DataFrame, **renamed: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in renamed.items()])
