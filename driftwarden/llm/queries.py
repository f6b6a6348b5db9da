"""The registered queries of these operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe, decontamination, license_scan, lm_scoring, metric_join, minhash_dedup, periodic_runs,
    piece_spans, quality_pu, secret_ledger, token_alignment, toxicity_knn, warc,
)
from .common import read
from .sql import SQL

TOKENIZER = "word_bpe_49k.json"
BYTES = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_pu(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    return quality_pu.quality_scores(docs, labels)


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(
        read(spark, folder, "documents"), read(spark, folder, "benchmark")
    )


def op3_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return secret_ledger.scan_report(read(spark, folder, "documents"))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_texts(read(spark, folder, "documents"), tokenizer_path())


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.cross_entropy_difference(
        read(spark, folder, "documents"), lm_scoring.trusted_documents(spark, folder)
    )


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(read(spark, folder, "pages"))


def op7_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, folder, "documents"))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_labels(read(spark, folder, "documents"))


def op9_toxicity_knn(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    return toxicity_knn.toxicity_scores(docs, labels)


def op10_metric_join(spark: SparkSession, folder: str) -> DataFrame:
    return metric_join.near_vectors(read(spark, folder, "embeddings"))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return token_alignment.aligned_documents(docs, tokenizer_path(BYTES), tokenizer_path(PIECES))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.repeated_runs(
        periodic_runs.with_periodic_tails(read(spark, folder, "documents"))
    )


def op13_piece_spans(spark: SparkSession, folder: str) -> DataFrame:
    return piece_spans.encode_pieces(read(spark, folder, "documents"), tokenizer_path(PIECES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
