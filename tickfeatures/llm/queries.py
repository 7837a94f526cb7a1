"""The operators bound to the test tables, with production parameters.

Each query reads its whole tables. ``ORACLE`` holds DuckDB SQL where SQL can express the
result; the other queries are tested against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_rotation, conversation_repair, dac, decontaminate, interpolated_lm, knn_quality, license_scan, order_minhash, partenum, token_alignment, toxicity, url_reputation

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# fixed values
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page outcomes: a page's path ends in the doc_id of its text, whose quality label is the outcome."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    shown = F.regexp_extract(url_reputation.path_of(F.col("url")), r"^/[a-z]+/([0-9]{1,18})", 1)
    of = pages.select("page_id", F.when(shown != "", shown).cast("bigint").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("outcome"))
    return url_reputation.judge(pages, of.join(labels, "doc_id").select("page_id", "outcome"), URL_RULES)


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER), outputs=("ids_sha256", "decoded_sha256"))


def op4_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("at").cast("bigint").alias("first_word"), F.round("similarity", 6).alias("similarity"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = dac.new_folder(spark, "token-ids")
    dac.write_ids(docs, public_tokenizers.path(TOKENIZER), folder, end_id=2)
    return dac.read_documents(spark, folder)


def op8_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), from_files=True)


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def crc_remainder(divisor: int):
    """crc32 of the doc_id as text, modulo the divisor."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def quality_model(docs: DataFrame, sf_dir: str) -> knn_quality.Model:
    labels = table(docs.sparkSession, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return knn_quality.train(docs, labels, crc_remainder(3) != 1)


def op10_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = knn_quality.score_documents(docs, quality_model(docs, sf_dir))
    return scored.select(
        "doc_id",
        F.coalesce(crc_remainder(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = token_alignment.align_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return aligned.withColumn("groups_sha256", digest).drop("groups")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversations, conversation_repair.damaged(conversations))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels, crc_remainder(5) != 0))
    return scored.select(
        "doc_id",
        F.coalesce(crc_remainder(5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {
    "op1_url_reputation": op1_url_reputation,
    "op2_chat_rotation": op2_chat_rotation,
    "op3_bpe_roundtrip": op3_bpe_roundtrip,
    "op4_partenum": op4_partenum,
    "op5_simhash_windows": op5_simhash_windows,
    "op6_license_scan": op6_license_scan,
    "op7_direct_codes": op7_direct_codes,
    "op8_interpolated_lm": op8_interpolated_lm,
    "op9_order_minhash": op9_order_minhash,
    "op10_knn_quality": op10_knn_quality,
    "op11_token_alignment": op11_token_alignment,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_toxicity": op13_toxicity,
}

from .oracle import ORACLE  # noqa: E402, F401
