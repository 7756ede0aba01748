"""Corpus pipeline: language, near duplicates, PII, mixture, tokens.

Each stage takes what the one before it kept, as Parquet; all but the last
return the columns of ``documents``. Null, empty and blank texts have no
language and are rejected by the first stage; a later stage that is given some
keeps them. Null ids stay null and are told apart row by row. Repeated rows are
copies, of which near_duplicates keeps one. Null languages and sources are
values of their own in the mixture. An empty table gives an empty result, and
columns other than those of ``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgraph.llm import bpe, common, langid, minhash, mixing, pii

#: Documents whose language is less certain than this are rejected; so are those without a letter.
LEAST_SCORE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that is known with some certainty; ``lang`` becomes the language predicted."""
    model = langid.fit_documents(docs)
    out = langid.identify(docs, model, keep=("doc_id", "text", "source", "n_chars"))
    kept = out.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays: the one with the smallest id, a null id last. Rows are judged one by one; ids may repeat."""
    rows = common.materialize(docs.select(*COLUMNS).withColumn("row_key", F.monotonically_increasing_id()), "rows")
    groups = common.materialize(minhash.near_duplicates(rows, minhash.for_similarity(5, 80), id_col="row_key").select("row_key", "component_id"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    least = groups.join(rows.select("row_key", "doc_id"), "row_key").groupBy("component_id").agg(F.min(order).alias("least")).select("least.row_key")
    gone = common.materialize(groups.join(least, "row_key", "left_anti").select("row_key"), "gone")
    common.release(groups)
    return common.within_ids(rows, gone, "row_key", "left_anti").select(*COLUMNS)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates."""
    return pii.replace_pii(docs.select(*COLUMNS), pii.key_of(spark)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents to the target shares of sources, languages and topics."""
    out = mixing.mix(docs.select(*COLUMNS), keep=COLUMNS)
    return out.filter("sampled").select(*[F.col("in_" + c).alias(c) for c in COLUMNS])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.digests(bpe.encode_decode(docs))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("surrogates", surrogates),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL cannot express language ID, candidate search and BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialize(docs, f"pipeline-{name}")
            if before is not None:
                common.release(before)  # written and read again: nothing reads it any more
            before = docs
    return docs
