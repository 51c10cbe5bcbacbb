"""The queries of the operators, with production parameters over whole tables; SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from descry.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from descry.llm import toxicity

    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from descry.llm import language

    return language.identify(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from descry.llm import tokencount

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from descry.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from descry.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from descry.llm import linededup

    return linededup.report(table(spark, sf_dir, "documents"))


#: The rules of op6: (verdict, host and path).
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from descry.llm import urlfilter

    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from descry.llm import orderminhash

    return orderminhash.compare(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from descry.llm import decontaminate

    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality, "op2_toxicity": op2_toxicity, "op3_language": op3_language, "op4_token_counts": op4_token_counts, "op9_bpe": op9_bpe,
    "op8_simhash": op8_simhash, "op6_url_filter": op6_url_filter, "op7_order_minhash": op7_order_minhash, "op5_line_dedup": op5_line_dedup,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {}
