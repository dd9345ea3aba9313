"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bin_packing, chat_format, collocations, jaccard_join, license_scan, lm_scoring, piece_codec, quality_classifier, quality_rules, secret_scan, token_counts, vector_codes, winnow
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_digests(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op3_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_report(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"), percent=90, width=3)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=512)


def op9_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack_documents(table(spark, sf_dir, "documents"))


#: Control strings as texts: conversation -7 of op10.
PROBE = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_turns(turns.unionByName(probe)))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best_phrases(table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = [op1_license_scan, op2_piece_codec, op3_winnow, op4_secret_scan, op5_quality_rules, op6_quality_classifier, op7_jaccard_join, op8_token_counts, op9_bin_packing, op10_chat_format, op11_vector_codes, op12_collocations, op13_lm_scoring]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.scan_sql(), "op11_vector_codes": vector_codes.compress_sql(), "op12_collocations": collocations.best_phrases_sql()}
