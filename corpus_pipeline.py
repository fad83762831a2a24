"""A corpus pipeline of five stages over ``documents``; each takes (spark, docs, sf_dir) and returns a DataFrame.

quality rules -> near-duplicate removal -> benchmark decontamination -> secret
redaction -> byte-level BPE.  The first three drop rows, the fourth changes
texts, the last returns token ids.  ``run`` writes each stage's rows as Parquet
in the cluster's shared folder and reads them again as the next one's input.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe, decontaminate, minhash, quality, secrets
from loomtext.llm.common import Staging, table
from loomtext.ship import ship


def _shipped(stage):
    """Workers can import the package wherever a stage is called from."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


@_shipped
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees; the trees learn from this stage's own input and ``labels``."""
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.passing(docs, trees)


@_shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at 0.8, the document with the smallest id; rows without id stay."""
    if not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _near_dedup_by_row(spark, docs)
    found = minhash.near_duplicates(docs, shingle=5, percent=80)
    return _without(docs, found.filter("not kept").select("doc_id"), "doc_id")


def _without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``docs`` without the rows that ``gone`` names; the list is written once and broadcast while it is short."""
    gone = Staging(docs.sparkSession).put(gone)
    few = F.broadcast(gone) if gone.count() <= minhash.BROADCAST_IDS else gone
    return docs.join(few, key, "left_anti")


def _near_dedup_by_row(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Where ids repeat, each row counts by its own text: one row of the smallest id stays of each group, and of equal rows without words."""
    row = "loomtext_row"
    numbered = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()).alias(row)
    rows = Staging(spark).put(docs.select("*", numbered))
    found = minhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), shingle=5, percent=80)
    linked = found.filter("doc_id is not null").select(F.col("doc_id").alias(row), "n_shingles", "component_id")
    marks = rows.select(row, F.col("doc_id").cast("long").alias("own_id"), F.md5("text").alias("mark"))
    wordless = F.col("n_shingles") == 0
    group = [F.when(~wordless, F.col("component_id")).alias("a"), F.when(wordless, F.col("own_id")).alias("b"), F.when(wordless, F.col("mark")).alias("c")]
    first = linked.join(marks, row).groupBy(*group).agg(F.min(F.struct("own_id", row)).alias("least")).select(F.col(f"least.{row}").alias(row))
    gone = rows.filter(F.col(row).isNotNull()).select(row).join(first, row, "left_anti")
    return _without(rows, gone, row).drop(row)


@_shipped
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that aligns with a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


@_shipped
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted anew."""
    return secrets.redacted(docs)


@_shipped
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, ids) of each document; older columns named n_tokens or ids are replaced."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode(docs, path, pattern, tuple(c for c in docs.columns if c not in ("text", "n_tokens", "ids")))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("bpe", tokenise),
]

#: The stages are beyond SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, staging = table(spark, sf_dir, "documents"), Staging(spark)
    for _, stage in STAGES:
        done = staging.put(stage(spark, docs, sf_dir))
        staging.drop_others(done)  # a stage's input goes when its rows are written
        docs = done
    return docs.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), " "))
