"""Queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession

from shutterlake.llm import fair_mix, filter_audit, golay_simhash, gram_join, line_join, matroska, oracles, pair_rank, piece_codec, prefix_trie, quality_rules, recompress, secret_cnn, surrogate

#: Where the public vocabularies lie; the folder is the same on every machine.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


#: The key of surrogates. Where none is set, one is drawn that nobody knows: surrogates then
#: agree within a session and differ between sessions.
SURROGATE_KEY = os.environ.get("SURROGATE_KEY", "").encode() or secrets.token_bytes(32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def piece_model() -> str:
    return f"{TOKENIZERS}/piece_bpe_32k.model"


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digest(documents(spark, sf_dir))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.token_digest(documents(spark, sf_dir), piece_model())


def op3_recompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.repeats_digest(documents(spark, sf_dir))


def op4_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join.lines_digest(documents(spark, sf_dir))


def op5_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_cnn.secrets_digest(documents(spark, sf_dir))


def op6_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.pii_digest(documents(spark, sf_dir), SURROGATE_KEY)


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix_digest(documents(spark, sf_dir))


def op8_pair_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_rank.score_digest(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_gram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram_join.jaccard_components(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules_digest(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_digest(table(spark, sf_dir, "conversations"))


def op12_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.simhash_components(documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
