"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sketchloom.llm import ann, chat, decontaminate, langid, lexical, minhash, mixing, packing, pii, secretscan, sharding, urlfilter, whitening
from sketchloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(spark, table(spark, sf_dir, "conversations"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.digest(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(table(spark, sf_dir, "embeddings"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(table(spark, sf_dir, "embeddings"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_pii": op1_pii,
        "op2_minhash": op2_minhash,
        "op3_sharding": op3_sharding,
        "op4_chat": op4_chat,
        "op5_url_filter": op5_url_filter,
        "op6_mixing": op6_mixing,
        "op7_language": op7_language,
        "op8_ann": op8_ann,
        "op9_decontaminate": op9_decontaminate,
        "op10_packing": op10_packing,
        "op11_whitening": op11_whitening,
        "op12_lexical": op12_lexical,
        "op13_secrets": op13_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": pii.sql(), "op2_minhash": minhash.sql(), "op5_url_filter": urlfilter.sql(), "op12_lexical": lexical.sql(), "op13_secrets": secretscan.sql()}
