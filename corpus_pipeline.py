"""The corpus pipeline: documents in, deduplicated, clean and tokenised documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwarden.llm import bpe, decontamination, minhash_dedup, quality_pu, secret_ledger
from driftwarden.llm.common import read, store
from driftwarden.llm.queries import tokenizer_path


KEY, SHARED = "key of the row", "the row shares its doc_id"
FEW = 1_000_000  # shared doc_ids up to which they are broadcast, 40 bytes each


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key that tells texts apart, so that a decision on one text deletes
    no other: the doc_id, but another number, larger than any doc_id below 2^62, for texts
    whose doc_id is null or belongs to another text. Equal rows share their key. The second
    column added says whether the doc_id is null or comes more than once."""
    content = F.xxhash64("doc_id", "text")
    shared = store(
        docs.groupBy(F.col("doc_id").alias("id"))
        .agg(F.count("*").alias("n"), F.min(content).alias("first"))
        .where("n > 1 or id is null"),
        "shared-ids",
    )
    found = shared.count()
    if not found:
        return docs.withColumns({KEY: F.col("doc_id").cast("long"), SHARED: F.lit(False)})
    other = F.broadcast(shared) if found <= FEW else shared
    own = F.col("n").isNull() | (F.col("id").isNotNull() & (F.col("first") == content))
    number = F.lit(1 << 62).cast("long") + F.shiftrightunsigned(content, 2)
    rows = docs.join(other, docs["doc_id"].eqNullSafe(F.col("id")), "left")
    return rows.withColumns(
        {KEY: F.when(own, F.col("doc_id").cast("long")).otherwise(number), SHARED: F.col("n").isNotNull()}
    ).drop("id", "n", "first")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    rows = keyed(docs)
    scores = quality_pu.quality_scores(_as_documents(rows), read(spark, sf_dir, "labels"))
    rejected = scores.where("predicted = 0").select(F.col("doc_id").alias(KEY)).distinct()
    return rows.join(rejected, KEY, "left_anti").select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, and of
    equal rows one. Texts without a doc_id of their own come after those that have one."""
    rows = keyed(docs)
    found = minhash_dedup.near_duplicates(_as_documents(rows))
    copies = found.where("not kept").select(F.col("doc_id").alias(KEY)).distinct()
    left = rows.join(copies, KEY, "left_anti")
    repeated = left.where(F.col(SHARED)).dropDuplicates([KEY])
    return left.where(~F.col(SHARED)).union(repeated).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    rows = keyed(docs)
    found = decontamination.contaminated(_as_documents(rows), read(spark, sf_dir, "benchmark"))
    hit = found.select(F.col("doc_id").alias(KEY)).distinct()
    return rows.join(hit, KEY, "left_anti").select(docs.columns)


def _as_documents(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(KEY).alias("doc_id"), "text")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; n_chars follows the new text."""
    masked = secret_ledger.redacted(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests."""
    return bpe.encode_texts(docs, tokenizer_path(), columns="ids")


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("bpe", encode),
]

#: Neither the classifier nor the tokenizer is expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stored and read again."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = store(docs, f"pipeline-{number}")
    return docs
