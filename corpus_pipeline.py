"""The corpus pipeline: documents in, piece ids out; each stage's output is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.llm import jaccard, mixing, pieces, secrets, toxicity
from headwater.llm.common import Scratch, bound_batches, table

# Every stage takes null and repeated keys, null, empty and very long texts and columns of any names; an empty table stays one.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose texts are not judged toxic; null and empty texts are judged by the thresholds alone."""
    bound_batches(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of similar texts, that of the least key; rows with a null key, and texts without words, stay."""
    bound_batches(spark)
    return jaccard.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts masked and ``n_chars`` counted again; null texts stay null."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their rates say; what is most likely good text stays at least once."""
    bound_batches(spark)
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row; null and empty texts have none."""
    bound_batches(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
    ("pieces", encode_pieces),
]
# A fitted model, an iterated join and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``. A stage's output is written, and goes once the next one's is."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{number}-{name}")
        if number:
            scratch.drop(f"{number - 1}-{STAGES[number - 1][0]}")
    return docs
