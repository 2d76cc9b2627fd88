"""The queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from boxwright.llm import attention_lm, chat, decontaminate, main_text, near_dup, oracles, pii, piece_codec, quality, repeated_units, token_shards
from boxwright.llm.common import shipped

PIECES, BYTES, END_ID = "piece_bpe_32k.model", "byte_bpe_50k.json", 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digests(_table(spark, sf_dir, "documents"))


def op3_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units.find(_table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_digests(_table(spark, sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.write_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), END_ID, added=True)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(_table(spark, sf_dir, "conversations"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_quality_rules, op3_repeated_units, op4_personal_data, op5_token_shards, op6_near_duplicates, op7_language_model, op8_decontamination, op9_chat_rotation, op10_main_text)}
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": oracles.OP2, "op9_chat_rotation": oracles.OP9}
