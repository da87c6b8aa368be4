"""The corpus pipeline: language ID, near-duplicates, secrets, source mix and packing, each stage on what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back as the next
one's docs. All stages but the last return the columns of documents. Stages are deterministic, so a lost executor's
work is simply done again.

SQL cannot express the stages as a whole (trained language models, a tokenizer); tests hold them to brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.llm import languages, mixing, ngram_join, packing, secrets
from quantloom.llm.spark_tools import join_checked, stage, table, temporary_tables


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with enough confidence."""
    return languages.identify_documents(docs).where("accepted").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, or any of its equal rows.

    Rows without a doc_id are kept once for each different text, whatever the named rows have: they have no place in a
    group, so near copies of theirs stay.
    """
    groups = ngram_join.jaccard_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    left = join_checked(docs, stage(groups), ["doc_id"], "left_anti").select(*docs.columns)
    doubled = stage(left.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"))
    if doubled.isEmpty():
        return left
    # rows that share a doc_id count as one document: the first of them by content stays; rows are kept in a struct, so
    # that columns of any name pass
    content = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    marked = left.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(content).alias("content"))
    named = marked.where("id is not null")
    first = stage(named.groupBy("id").agg(F.min("content").alias("content")))
    named = named.join(first, ["id", "content"], "left_semi").dropDuplicates(["id", "content"])
    kept = named.select("row").unionByName(marked.where("id is null").dropDuplicates(["content"]).select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings are replaced in the text and n_chars follows; no document is dropped."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares: each document as often as the mix takes it."""
    taken = mixing.repeat_rows(docs)
    return taken.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix with their places in sequences."""
    pieces = stage(packing.token_pieces(docs))
    return packing.pack(pieces, ["doc_id", "piece", "start", "ids_crc32"])


STAGES = [
    ("language ID", keep_languages),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("source mix", mix),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES:
        with temporary_tables(spark):  # what a stage has staged for itself goes when its result is written
            docs = stage(function(spark, docs, sf_dir), temporary=False)
    return docs
