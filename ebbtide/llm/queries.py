"""Registered queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import (
    byte_bpe,
    context_tree,
    decontaminate,
    fuzzy_lines,
    hard_negatives,
    language_kernel,
    license_templates,
    merkle,
    order_minhash,
    piece_bpe,
    private_data,
    quality_knn,
    rotated_codes,
)
from ebbtide.llm.oracles import HARD_NEGATIVES, MERKLE
from ebbtide.llm.sampling import crc_mod, held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.fit(docs.where(~held_out(F.col("doc_id"), 3, 1)), table(spark, sf_dir, "labels"))
    scored = quality_knn.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.scan(table(spark, sf_dir, "documents"), ["doc_id"])


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_kernel.fit(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    found = language_kernel.predict(docs, model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.membership_of(table(spark, sf_dir, "documents"))


def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def deduplicated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = fuzzy_lines.deduplicate(docs, report=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 5, 1))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.digest(private_data.find(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, F.coalesce(crc_mod(docs["doc_id"], 3) == 0, F.lit(False)), merkle.lowered(docs["text"]))


def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def hard_negative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.usable(rows, label, F.col("vec_id") % 50 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_knn": quality_classifier,
    "op2_order_minhash": near_duplicates,
    "op3_rotated_codes": nearest_neighbours,
    "op4_license_templates": license_scan,
    "op5_byte_bpe": bpe_round_trip,
    "op6_context_tree": context_tree_scores,
    "op7_private_data": personal_data,
    "op8_language_kernel": language_id,
    "op9_decontaminate": contaminated,
    "op10_fuzzy_lines": deduplicated_lines,
    "op11_merkle_manifest": merkle_manifest,
    "op12_piece_bpe": piece_round_trip,
    "op13_hard_negatives": hard_negative_rows,
}

ORACLES: dict[str, str] = {"op11_merkle_manifest": MERKLE, "op13_hard_negatives": HARD_NEGATIVES}
