"""URL filter by a path-template tree.

Each host has a tree of path segments. Segments with digits and very long ones
are wildcards from the start. Level by level from the root, where a new page
would most likely show a segment not seen before (half the pages under a node
or more are the only ones with theirs), all segments but the common ones are
generalised into one wildcard. Labels are summed up to every node. Siblings
that do not differ from the others under their parent by ``z`` standard errors
are one branch; those that do differ are merged with their neighbours in
purity where these do not differ from each other. From the root down, the purity
of a branch is smoothed towards its parent's, and a page is rejected if the
purity of its template is below ``min_purity``. Written rules go before the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, materialize, release

#: Fixed values of the contract: verdict, host, path prefix.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Deeper levels are one wildcard.
LEVELS = 5
#: A leaf with more than this share of all pages is hot: there are fewer than 1,000, whose rows are spread over so many salts.
HOT_SHARE, SALTS = 0.001, 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def template_of(path: Column, levels: int = LEVELS) -> Column:
    """Literal segments stay; segments with a digit or of 24 and more characters become ``*``, with their extension kept; what is deeper than ``levels`` becomes ``**``."""
    t = F.regexp_replace(path, r"/[^/.]*[0-9][^/.]*", "/*")
    t = F.regexp_replace(t, r"/[^/]{24,}", "/*")
    t = F.regexp_replace(t, r"/+\z", "")
    return F.regexp_replace(t, rf"\A([^/]*(?:/[^/]*){{{levels - 1}}})/[^/]*/.*", "$1/**")


def _generalised(leaves: DataFrame, level: int, unseen: float, common: float, least: int) -> DataFrame:
    """Adds ``t<level>``: the template up to this level; a segment becomes ``*`` where segments vary and it is not common."""
    up, seg, t = f"t{level - 1}", f"s{level}", f"t{level}"
    child = leaves.filter(F.col(seg).isNotNull()).groupBy("host", up, seg).agg(F.sum("n").alias("c"))
    parent = child.groupBy("host", up).agg(F.sum("c").alias("all"), F.count_if(F.col("c") == 1).alias("once"), F.count(F.lit(1)).alias("k"))
    varies = parent.filter((F.col("k") >= least) & (F.col("once") >= unseen * F.col("all")))
    wild = child.join(varies, ["host", up]).filter(F.col("c") < common * F.col("all")).select("host", up, seg, F.lit(True).alias("wild"))
    named = F.concat(up, F.lit("/"), F.when(F.col("wild"), "*").otherwise(F.col(seg)))
    return leaves.join(wild, ["host", up, seg], "left").withColumn(t, F.when(F.col(seg).isNull(), F.col(up)).otherwise(named)).drop("wild")


def _branches(leaves: DataFrame, level: int, above: DataFrame, prior: float, z: float) -> DataFrame:
    """host, node, branch, purity of the nodes of a level; ``above`` has those of the level before."""
    up, t = f"t{level - 1}", f"t{level}"
    nodes = leaves.filter(F.col(f"s{level}").isNotNull()).groupBy("host", F.col(up).alias("parent"), F.col(t).alias("node")).agg(F.sum("m").alias("m"), F.sum("g").alias("g"))
    of = Window.partitionBy("host", "parent")
    nodes = nodes.withColumns({"pm": F.sum("m").over(of), "pg": F.sum("g").over(of), "p": (F.col("g") + 1) / (F.col("m") + 2)})
    share, rest = F.try_divide(F.col("pg"), F.col("pm")), F.col("pm") - F.col("m")
    error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), F.col("m")) + F.try_divide(F.lit(1.0), rest)))
    gap = F.try_divide(F.col("g"), F.col("m")) - F.try_divide(F.col("pg") - F.col("g"), rest)  # null without labels on either side
    nodes = nodes.withColumn("side", F.when(gap > z * error, "+").when(-gap > z * error, "-").otherwise("~"))
    line = Window.partitionBy("host", "parent", "side").orderBy("p", "node")
    own, before = F.col("p") * (1 - F.col("p")) / (F.col("m") + 2), F.lag(F.col("p") * (1 - F.col("p")) / (F.col("m") + 2)).over(line)
    cut = F.coalesce((F.col("p") - F.lag("p").over(line)) > z * F.sqrt(own + before), F.lit(False)) & (F.col("side") != "~")
    nodes = nodes.withColumn("cut", cut.cast("int"))
    nodes = nodes.withColumn("branch", F.concat("parent", F.lit(" "), "side", F.sum("cut").over(line).cast("string")))
    branch = Window.partitionBy("host", "parent", "branch")
    nodes = nodes.withColumns({"bm": F.sum("m").over(branch), "bg": F.sum("g").over(branch)})
    nodes = nodes.join(above.select("host", F.col("node").alias("parent"), F.col("purity").alias("above")), ["host", "parent"])
    return nodes.select("host", "node", "branch", ((F.col("bg") + prior * F.col("above")) / (F.col("bm") + prior)).alias("purity"))


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules=RULES,
    min_purity: float = 0.5,
    prior: float = 8.0,
    z: float = 1.96,
    unseen: float = 0.5,
    common: float = 0.05,
    least: int = 5,
    page_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Judge every page's url.

    ``labels`` has ``page`` (long, at most one row for each) and ``good`` (0 or 1).
    A node with at least ``least`` different segments below it varies where the
    pages that are alone with their segment are the share ``unseen`` or more; a
    segment that holds the share ``common`` of the pages stays as it is.
    Returns one row per input row: ``page_col``, ``host``, ``path``, ``rule``,
    ``verdict`` ('allow' or 'block'), ``template``, ``branch`` and ``purity`` (of
    the branch, smoothed). A null url, or one without ``://``, has an empty host
    and path and is judged with the other such rows. Hosts without labels take
    the purity of all hosts; without any labels the purity is 1 and everything
    that no rule blocks is allowed. Repeated rows and ids stay as they are.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(page_col).alias("__page"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("literal", template_of(F.col("path")))
    good = labels.select(F.col("page").alias("__lp"), F.col("good").cast("double").alias("good")).filter("__lp is not null and good is not null")
    known = rows.join(good, F.col("__page") == F.col("__lp"), "left")
    # leaves of the trees: page counts and labels, summed before any row is moved
    leaves = known.groupBy("host", "literal").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("m"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("g"))
    parts = F.split("literal", "/")
    leaves = leaves.select("*", F.lit("").alias("t0"), *[F.try_element_at(parts, F.lit(k + 1)).alias(f"s{k}") for k in range(1, LEVELS + 1)])
    leaves = materialize(leaves, "leaves")
    pages_in_all, am, ag, deepest = leaves.agg(F.sum("n"), F.sum("m"), F.sum("g"), F.max(F.size(parts)) - 1).first()
    deepest = min(LEVELS, max(0, deepest or 0))
    for level in range(1, deepest + 1):
        before, leaves = leaves, materialize(_generalised(leaves, level, unseen, common, least), "leaves")
        release(before)
    p0 = ag / am if am else 1.0
    level_nodes = leaves.groupBy("host").agg(F.sum("m").alias("m"), F.sum("g").alias("g")).select("host", F.lit("").alias("node"), F.lit(" ~0").alias("branch"), ((F.col("g") + prior * p0) / (F.col("m") + prior)).alias("purity"))
    nodes = level_nodes = materialize(level_nodes, "nodes")
    for level in range(1, deepest + 1):
        level_nodes = materialize(_branches(leaves, level, level_nodes, prior, z), "nodes")
        nodes = nodes.union(level_nodes)
    judged = leaves.select("host", "literal", "n", F.col(f"t{deepest}").alias("node")).join(nodes, ["host", "node"])
    judged = materialize(judged.select("host", "literal", F.col("node").alias("template"), "branch", "purity", F.xxhash64("host", "literal").alias("leaf"), "n"), "judged")
    hot = [r[0] for r in judged.filter(F.col("n") > HOT_SHARE * (pages_in_all or 0)).select("leaf").collect()]  # under 1,000
    of_leaf = F.xxhash64("host", "literal").isin(hot) if hot else F.lit(False)
    salted = judged.withColumn("salt", F.explode(F.when(F.col("leaf").isin(hot) if hot else F.lit(False), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("leaf", "n")
    out = rows.withColumn("salt", F.when(of_leaf, F.pmod(F.xxhash64("__page", "path"), F.lit(SALTS)).cast("int")).otherwise(0)).join(salted, ["host", "literal", "salt"])
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return out.select(
        F.col("__page").alias(page_col), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("purity") < min_purity, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", "branch", F.round("purity", 9).alias("purity"),
    )


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of pages through the document number that ends their path: good is quality 1 and not toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?\z", 1)
    keyed = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id"))
    judged = labels.groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    return keyed.join(judged, "doc_id").groupBy(F.col("page_id").alias("page")).agg(F.min("good").alias("good"))


def op2_template_tree(spark, sf_dir: str) -> DataFrame:
    """Every url of pages, with the labels of the documents that the pages show."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, page_labels(pages, load(spark, sf_dir, "labels")))


_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1)"



def _tree_sql() -> str:
    """The tree as common table expressions, level by level."""
    out = []
    for d in range(1, LEVELS + 1):
        before = f"l{d - 1}"
        out.append(f"""
c{d} AS (SELECT host, t{d - 1}, s{d}, sum(n) AS c FROM {before} WHERE s{d} IS NOT NULL GROUP BY ALL),
v{d} AS (SELECT host, t{d - 1}, sum(c) AS every FROM c{d} GROUP BY ALL HAVING count(*) >= 5 AND count(*) FILTER (c = 1) >= 0.5::DOUBLE * sum(c)),
l{d} AS (SELECT l.*, CASE WHEN l.s{d} IS NULL THEN l.t{d - 1} ELSE l.t{d - 1} || '/' || CASE WHEN c < 0.05::DOUBLE * every THEN '*' ELSE l.s{d} END END AS t{d}
  FROM {before} l LEFT JOIN v{d} v ON v.host = l.host AND v.t{d - 1} = l.t{d - 1} LEFT JOIN c{d} c ON c.host = l.host AND c.t{d - 1} = l.t{d - 1} AND c.s{d} = l.s{d})""")
    out.append("""
h AS (SELECT host, sum(m) AS m, sum(g) AS g FROM l0 GROUP BY host),
p AS (SELECT CASE WHEN sum(m) > 0 THEN sum(g) / sum(m) ELSE 1.0 END::DOUBLE AS p0 FROM h),
b0 AS (SELECT host, '' AS node, ' ~0' AS branch, (g + 8.0::DOUBLE * p0) / (m + 8.0::DOUBLE) AS purity FROM h, p)""")
    for d in range(1, LEVELS + 1):
        out.append(f"""
n{d} AS (SELECT host, t{d - 1} AS parent, t{d} AS node, sum(m) AS m, sum(g) AS g FROM l{LEVELS} WHERE s{d} IS NOT NULL GROUP BY ALL),
w{d} AS (SELECT *, sum(m) OVER x AS pm, sum(g) OVER x AS pg, (g + 1) / (m + 2)::DOUBLE AS p FROM n{d} WINDOW x AS (PARTITION BY host, parent)),
x{d} AS (SELECT *, CASE WHEN m > 0 AND pm - m > 0 THEN g / m - (pg - g) / (pm - m) END AS gap,
         CASE WHEN m > 0 AND pm - m > 0 THEN 1.96::DOUBLE * sqrt(pg / pm * (1 - pg / pm) * (1.0::DOUBLE / m + 1.0::DOUBLE / (pm - m))) END AS err FROM w{d}),
y{d} AS (SELECT *, CASE WHEN gap > err THEN '+' WHEN -gap > err THEN '-' ELSE '~' END AS side FROM x{d}),
z{d} AS (SELECT *, (side <> '~' AND coalesce(p - lag(p) OVER o > 1.96::DOUBLE * sqrt(p * (1 - p) / (m + 2) + lag(p * (1 - p) / (m + 2)) OVER o), false))::INT AS cut
         FROM y{d} WINDOW o AS (PARTITION BY host, parent, side ORDER BY p, node)),
q{d} AS (SELECT *, parent || ' ' || side || (sum(cut) OVER (PARTITION BY host, parent, side ORDER BY p, node))::VARCHAR AS branch FROM z{d}),
b{d} AS (SELECT q.host, q.node, q.branch, (sum(q.g) OVER (PARTITION BY q.host, q.parent, q.branch) + 8.0::DOUBLE * b.purity) / (sum(q.m) OVER (PARTITION BY q.host, q.parent, q.branch) + 8.0::DOUBLE) AS purity
         FROM q{d} q JOIN b{d - 1} b ON b.host = q.host AND b.node = q.parent)""")
    every = " UNION ALL ".join(f"SELECT * FROM b{d}" for d in range(LEVELS + 1))
    return ",".join(out) + f",\nnode AS ({every})"


OP2_SQL = rf"""
WITH rows AS (
  SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
lit AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '/[^/.]*[0-9][^/.]*', '/*', 'g'), '/[^/]{{24,}}', '/*', 'g'), '/+\z', ''), '\A([^/]*(?:/[^/]*){{{{{LEVELS - 1}}}}})/[^/]*/.*', '\1/**') AS literal,
         try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.[a-z]+)?/?\z', 1), '') AS BIGINT) AS doc_id FROM rows),
lab AS (SELECT doc_id, min((quality = 1 AND toxic = 0)::INT) AS good FROM labels GROUP BY doc_id),
plab AS (SELECT page_id, min(good) AS good FROM lit JOIN lab USING (doc_id) GROUP BY page_id),
known AS (SELECT lit.*, plab.good FROM lit LEFT JOIN plab USING (page_id)),
l0 AS (
  SELECT host, literal, count(*) AS n, count(good) AS m, coalesce(sum(good), 0)::DOUBLE AS g, '' AS t0,
         {", ".join(f"string_split(literal, '/')[{k + 1}] AS s{k}" for k in range(1, LEVELS + 1))} FROM known GROUP BY host, literal),{_tree_sql()},
judged AS (SELECT l.host, l.literal, node.node AS template, branch, purity FROM l{LEVELS} l JOIN node ON node.host = l.host AND node.node = l.t{LEVELS}),
fit AS (
  SELECT lit.*, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'allow www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'block example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'block net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'block net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'allow com/' END AS fitted FROM lit)
SELECT page_id, fit.host, path, fitted[7:] AS rule,
       CASE WHEN fitted IS NOT NULL THEN fitted[:5] WHEN purity < 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       template, branch, round(purity, 9) AS purity
FROM fit JOIN judged ON judged.host = fit.host AND judged.literal = fit.literal
"""
