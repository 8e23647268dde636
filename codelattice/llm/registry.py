"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .fingerprints import fingerprints
from .frames import read
from .hard_negatives import mine
from .infilling import infill_digests
from .language_id import held_out, identify
from .minhash import near_duplicates
from .mixing import mix
from .oracles import ORACLES
from .preferences import conversation_pairs, format_preferences
from .quality import judge
from .suffix_dedup import repeated_passages
from .token_counts import token_counts
from .token_files import write_and_read
from .toxicity import toxicity


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = identify(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents")).drop("tie")


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = format_preferences(conversation_pairs(read(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), " ")
    return got.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, vocabulary=50257)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill_digests(read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = mine(read(spark, sf_dir, "embeddings"), label=label)
    return got.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out)
    first = F.get("evidence", F.lit(0))
    return got.select("doc_id", "held_out", "score", "predicted", first["doc_id"].alias("nearest_id"), first["similarity"].alias("nearest_similarity"), first["label"].alias("nearest_label"))


__all__ = ["ORACLES", "QUERIES", "tokenizer_path"]

QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_language_id": op2_language_id,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_mix_sources": op4_mix_sources,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_preference_format": op6_preference_format,
    "op7_token_counts": op7_token_counts,
    "op8_token_files": op8_token_files,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_toxicity": op13_toxicity,
}
