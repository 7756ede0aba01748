"""What common C library functions do to memory, as a table of actions.

Actions: read and write of an argument's memory, heap result, merge of argument
and result, and copy between the memories of two arguments. The table states
the C standard's behaviour of each function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: actions; r<i> reads argument i, w<i> writes it, h returns heap memory, m<i> returns argument i's memory, c<i><j> copies j's pointers to i.
FUNCTIONS = {
    "malloc": "h", "calloc": "h", "realloc": "h m0", "strdup": "h r0", "free": "w0",
    "memcpy": "w0 r1 m0 c01", "memmove": "w0 r1 m0 c01", "memset": "w0 m0", "memcmp": "r0 r1", "memchr": "r0 m0",
    "strcpy": "w0 r1 m0", "strncpy": "w0 r1 m0", "strcat": "r0 w0 r1 m0", "strncat": "r0 w0 r1 m0", "strcmp": "r0 r1", "strncmp": "r0 r1",
    "strlen": "r0", "strchr": "r0 m0", "strrchr": "r0 m0", "strstr": "r0 r1 m0", "strpbrk": "r0 r1 m0", "strtok": "r0 w0 r1 m0",
    "strtol": "r0 w1", "strtoul": "r0 w1", "strtod": "r0 w1", "atoi": "r0", "atol": "r0", "atof": "r0",
    "fopen": "h r0 r1", "fclose": "r0 w0", "fread": "w0 r3 w3", "fwrite": "r0 r3 w3", "fgets": "w0 r2 w2 m0", "fputs": "r0 r1 w1", "fgetc": "r0 w0", "fputc": "r1 w1",
    "fseek": "r0 w0", "ftell": "r0", "fflush": "w0", "feof": "r0", "ferror": "r0", "puts": "r0", "printf": "r0", "fprintf": "r0 w0 r1", "sprintf": "w0 r1", "snprintf": "w0 r2",
    "scanf": "r0", "fscanf": "r0 w0 r1", "sscanf": "r0 r1", "getenv": "r0", "qsort": "r0 w0", "bsearch": "r0 r1 m1", "time": "w0", "gmtime": "r0", "mktime": "r0 w0", "remove": "r0", "rename": "r0 r1",
}

VERBS = {"r": "read", "w": "write", "h": "heap", "m": "merge", "c": "copy"}


def rows() -> list[tuple[str, str, int, int]]:
    out = []
    for name, actions in FUNCTIONS.items():
        for a in actions.split():
            out.append((name, VERBS[a[0]], int(a[1]) if len(a) > 1 else -1, int(a[2]) if len(a) > 2 else -1))
    return out


def spec(spark: SparkSession) -> DataFrame:
    """(name, action, arg, other); -1 where an action has no argument."""
    return spark.createDataFrame(rows(), "name string, action string, arg int, other int")


def sql() -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{a}', {i}, {j})" for n, a, i, j in rows()) + ") t(name, action, arg, other)"
