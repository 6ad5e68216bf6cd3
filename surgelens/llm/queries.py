"""Registered queries of the operators and the pipeline, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from surgelens.llm import (best_fit, cross_parsing, line_spread, permutation_index, pii_votes, piece_bpe, prefix_trie, quality_gam,
                           repetition, simhash_bk, token_planes, warc_bundles, whitening)
from surgelens.llm.common import table


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.op2(spark, table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.op3(table(spark, sf_dir, "documents"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.op4(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.op5(spark, table(spark, sf_dir, "pages"))


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.op6(table(spark, sf_dir, "documents"))


def op7_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.op7(table(spark, sf_dir, "documents"))


def op8_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_votes.op8(table(spark, sf_dir, "documents"))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.op9(table(spark, sf_dir, "embeddings"))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.op10(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op11(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op12(table(spark, sf_dir, "conversations"))


def op13_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parsing.op13(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_gam": op1_quality_gam,
    "op2_token_planes": op2_token_planes,
    "op3_simhash": op3_simhash,
    "op4_best_fit": op4_best_fit,
    "op5_warc": op5_warc,
    "op6_repetition": op6_repetition,
    "op7_piece_bpe": op7_piece_bpe,
    "op8_pii_votes": op8_pii_votes,
    "op9_permutation_index": op9_permutation_index,
    "op10_line_spread": op10_line_spread,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_cross_parsing": op13_cross_parsing,
}
SQL: dict[str, str] = {"op5_warc": warc_bundles.SQL, "op10_line_spread": line_spread.SQL, "op12_prefix_trie": prefix_trie.SQL}
