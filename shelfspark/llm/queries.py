"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_transducer, code_search, decontaminate, fill_middle, hilbert_shards, html_text, line_dedup, metric_join, mixing, near_dup, quality, substring_dedup, token_output
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokens_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.digest(table(spark, sf_dir, "documents"))


def op10_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op3_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.shard_digest(table(spark, sf_dir, "documents"))


def op6_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.text_digest(table(spark, sf_dir, "pages"))


def op8_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(table(spark, sf_dir, "documents"))


def op11_equal_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_search.digest(table(spark, sf_dir, "embeddings"))


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf_dir, "documents"))


QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_token_planes": op2_token_planes, "op3_template_leaks": op3_template_leaks, "op4_metric_join": op4_metric_join, "op5_hilbert_shards": op5_hilbert_shards, "op6_attention_mil": op6_attention_mil, "op7_host_suffixes": op7_host_suffixes, "op8_flow_mix": op8_flow_mix, "op9_hyperminhash": op9_hyperminhash, "op10_super_kmers": op10_super_kmers, "op11_equal_average": op11_equal_average, "op12_bpe_transducer": op12_bpe_transducer, "op13_fill_middle": op13_fill_middle}
ORACLES: dict[str, str] = {"op1_line_dedup": line_dedup.SQL, "op4_metric_join": metric_join.SQL, "op9_hyperminhash": near_dup.SQL, "op10_super_kmers": substring_dedup.SQL, "op11_equal_average": code_search.SQL, "op13_fill_middle": fill_middle.SQL}
