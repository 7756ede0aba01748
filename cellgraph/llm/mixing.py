"""Mixing by iterative proportional fitting.

Documents are summed into cells of (source, language, topic). Raking scales the
cells' token mass in turn to the target share of each source, language and
topic until all three marginals hold. A cell's mass over its tokens is the
weight of its documents. Probabilities are the weights times one factor, which
is calibrated so that the tokens sampled are a given share of all; where that
would exceed 1, all documents of the cell are taken and the others make up for
it, so that no cell's weight decides how much of the others stays. A document is
sampled by a fixed hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, materialize, release

DIMENSIONS = ("source", "lang", "topic")
MISSING = "(none)"
SALTS = 16


def topic_of(text: Column) -> Column:
    """A coarse lexical topic of a text: table, legal, long or prose."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(t.contains("|"), "table").when(t.contains("icense"), "legal").when(F.octet_length(t) >= 8000, "long").otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Estimated tokens: a fourth of the UTF-8 bytes, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) / 4)).cast("long")


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares of a dimension: its token shares to a power below 1, which lifts the small ones."""
    own = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("t"))
    return own.withColumn("share", F.col("t") / F.sum("t").over(Window.partitionBy(F.lit(0)))).select(dimension, "share")


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 60, per_step: int = 5, tolerance: float = 1e-10) -> DataFrame:
    """cells (the dimensions, tokens) with ``mass`` whose marginals are the target shares.

    ``targets`` has for each dimension a table (dimension, share). A value
    without a target, or with share 0, gets no mass; targets of values without
    tokens are spread over the others. Stops when no marginal is off by more
    than ``tolerance`` of itself, or after ``rounds`` rounds.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    work = cells.withColumn("mass", F.col("tokens").cast("double"))
    for d, t in targets.items():
        t = t.join(cells.select(d).distinct(), d, "left_semi")
        t = t.withColumn(f"t_{d}", F.col("share") / F.sum("share").over(Window.partitionBy(F.lit(0))) * float(total)).drop("share")
        work = work.join(t, d, "left").fillna(0.0, [f"t_{d}"])
    work = materialize(work, "mass")
    for _ in range(-(-rounds // per_step)):
        new = work
        for _ in range(per_step):
            for d in targets:
                new = new.withColumn("mass", F.col("mass") * F.coalesce(F.try_divide(F.col(f"t_{d}"), F.sum("mass").over(Window.partitionBy(d))), F.lit(0.0)))
        new = materialize(new, "mass")
        release(work)
        work = new
        worst = 0.0
        for d in targets:
            gap = work.groupBy(d).agg(F.sum("mass").alias("m"), F.first(f"t_{d}").alias("t")).agg(F.max(F.abs(F.coalesce(F.try_divide(F.col("m"), F.col("t")), F.lit(1.0)) - 1))).first()[0]
            worst = max(worst, gap or 0.0)
        if worst <= tolerance:
            break
    return work.select(*targets, "tokens", "mass")


def calibrated(weights: DataFrame, share: float) -> float:
    """The factor on the weights for which the expected tokens sampled are ``share`` of all, with probabilities of 1 at most.

    ``weights`` has tokens and weight of the cells; each round takes the cells
    that reach 1 out of the sum, until none is added.
    """
    tokens, mass = F.col("tokens").cast("double"), F.col("tokens") * F.col("weight")
    budget = share * float(weights.agg(F.sum(tokens)).first()[0] or 0)
    factor, full = 0.0, -1
    while True:
        at_one = F.col("weight") * factor >= 1
        n, taken, rest = weights.agg(F.count_if(at_one), F.sum(F.when(at_one, tokens)), F.sum(F.when(~at_one, mass))).first()
        if n == full or not rest:
            return factor if rest or factor else 1.0
        factor, full = max(factor, (budget - (taken or 0.0)) / rest), n


def uniform(id_col: Column, seed: str) -> Column:
    """A fixed number in [0, 1) for each id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, power: float = 0.8, share: float = 0.6, targets: dict[str, DataFrame] | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Sampling decisions of every document.

    ``targets`` gives tables (dimension, share) for source, lang and topic; a
    dimension not given gets its own token shares to the ``power``. ``share`` of all
    tokens is sampled (in expectation). Returns one
    row per input row: ``id_col``, ``source``, ``lang``, ``topic``, ``n_tokens``,
    ``weight`` (mass over tokens), ``probability`` and ``sampled``, and the
    columns of ``keep`` (prefixed ``in_``). Null sources and languages are one
    value, ``(none)``; a null text is one token of prose. Rows that repeat an id
    share one random number. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("__id"), *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in DIMENSIONS[:2]], topic_of(F.col(text_col)).alias("topic"), tokens_of(F.col(text_col)).alias("n_tokens"), *[F.col(c).alias("in_" + c) for c in keep])
    cells = materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    made = {d: (targets or {}).get(d) or tempered(cells, d, power) for d in DIMENSIONS}
    weights = rake(cells, made).withColumn("weight", F.col("mass") / F.col("tokens"))
    factor = calibrated(weights, share)
    weights = weights.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), F.col("weight") * F.lit(factor)).alias("probability"))
    weights = materialize(weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "weights")  # its size in bytes is known to the planner; a large one is joined by cell and salt
    out = rows.withColumn("salt", F.pmod(F.xxhash64("__id", "n_tokens"), F.lit(SALTS)).cast("int")).join(weights, [*DIMENSIONS, "salt"])
    return out.select(
        F.col("__id").alias(id_col), *DIMENSIONS, "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"),
        (uniform(F.col("__id"), seed) < F.col("probability")).alias("sampled"), *["in_" + c for c in keep],
    )


def op3_raked_mixture(spark, sf_dir: str) -> DataFrame:
    """Calibrated sampling probabilities of all documents."""
    return mix(load(spark, sf_dir, "documents"))


def _sql(rounds: int = 60, power: float = 0.8, share: float = 0.6) -> str:
    topic = "CASE WHEN contains(coalesce(text, ''), '|') THEN 'table' WHEN contains(coalesce(text, ''), 'icense') THEN 'legal' WHEN strlen(coalesce(text, '')) >= 8000 THEN 'long' ELSE 'prose' END"
    steps, before = [], "t0"
    for d in DIMENSIONS:
        steps.append(f"(SELECT * EXCLUDE mass, mass * t_{d} / sum(mass) OVER (PARTITION BY {d}) AS mass FROM {{}}) x_{d}")
    step = "it"
    for s in steps:
        step = s.format(step)
    shares = ", ".join(f"t_{d} AS (SELECT {d}, pow(sum(tokens)::DOUBLE, {power}::DOUBLE) / sum(pow(sum(tokens)::DOUBLE, {power}::DOUBLE)) OVER () * (SELECT sum(tokens) FROM cells)::DOUBLE AS t_{d} FROM cells GROUP BY {d})" for d in DIMENSIONS)
    joins = " ".join(f"JOIN t_{d} USING ({d})" for d in DIMENSIONS)
    return f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce(source, '{MISSING}') AS source, coalesce(lang, '{MISSING}') AS lang, {topic} AS topic,
         greatest(1, ceil(strlen(coalesce(text, '')) / 4.0))::BIGINT AS n_tokens FROM documents),
cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM rows GROUP BY ALL),
{shares},
it AS (
  SELECT cells.*, t_source, t_lang, t_topic, tokens::DOUBLE AS mass, 0 AS k FROM cells {joins}
  UNION ALL
  SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, mass, k + 1 FROM {step} WHERE k < {rounds}),
w AS (SELECT source, lang, topic, tokens, mass / tokens AS weight FROM it WHERE k = {rounds}),
c AS (SELECT weight, ({share}::DOUBLE * sum(tokens) OVER () - coalesce(sum(tokens) OVER x, 0)) / (sum(tokens * weight) OVER () - coalesce(sum(tokens * weight) OVER x, 0)) AS factor
  FROM w WINDOW x AS (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT factor FROM c WHERE weight * factor <= 1 ORDER BY weight DESC LIMIT 1),
p AS (SELECT *, least(1.0::DOUBLE, weight * (SELECT factor FROM f)) AS probability FROM w)
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
       ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE < probability AS sampled
FROM rows JOIN p USING (source, lang, topic)
"""


OP3_SQL = _sql()
