"""The registered queries of the operators, over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.llm import alignment, brown, jaccard, language, licenses, mixing, neighbours, pieces, quality, secrets, toxicity
from headwater.llm.common import table
from headwater.llm.hard_negatives import mine_hard_negatives
from headwater.llm.token_counts import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES["op10_token_counts"] = op10_token_counts


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op7_pieces"] = op7_pieces


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


QUERIES["op8_quality_rules"] = op8_quality_rules
ORACLES["op8_quality_rules"] = quality.ORACLE


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


QUERIES["op5_secret_scans"] = op5_secret_scans


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_held_out(table(spark, sf_dir, "documents"))


QUERIES["op1_language_id"] = op1_language_id


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op2_toxicity"] = op2_toxicity


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


QUERIES["op3_jaccard_join"] = op3_jaccard_join


def op4_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_held_out(table(spark, sf_dir, "documents"))


QUERIES["op4_brown_scores"] = op4_brown_scores


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES["op9_nearest_neighbours"] = op9_nearest_neighbours


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op6_source_mixing"] = op6_source_mixing


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES["op13_license_scans"] = op13_license_scans
ORACLES["op13_license_scans"] = licenses.ORACLE


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op11_token_alignment"] = op11_token_alignment


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES["op12_hard_negatives"] = op12_hard_negatives
