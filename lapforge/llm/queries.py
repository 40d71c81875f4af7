"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lapforge.llm import divergence, line_quality, line_runs, segment_search
from lapforge.llm.html_paths import extract_pages
from lapforge.llm.kneser_ney import perplexity_report
from lapforge.llm.latent_leaks import benchmark_leaks
from lapforge.llm.mixing import mix_report
from lapforge.llm.pair_index import round_trip_report
from lapforge.llm.paragraphs import paragraph_report
from lapforge.llm.parity_join import parity_sketch_join
from lapforge.llm.tables import read_table
from lapforge.llm.token_files import token_report
from lapforge.llm.toxicity import score_chain, train_chain


def op1_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_chain(docs, train_chain(docs, read_table(spark, sf_dir, "labels")))


def op2_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_report(read_table(spark, sf_dir, "documents"))


def op3_token_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(read_table(spark, sf_dir, "documents"))


def op4_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op5_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_quality_report(read_table(spark, sf_dir, "documents"))


def op6_kneser_ney_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read_table(spark, sf_dir, "documents"))


def op8_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_sketch_join(read_table(spark, sf_dir, "documents"), words=4, percent=85, links=True)


def op9_line_run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.line_run_report(read_table(spark, sf_dir, "documents"))


def op9_single_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.line_run_report(read_table(spark, sf_dir, "documents"), min_lines=1)


def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_segment_filtering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_search.mining_report(read_table(spark, sf_dir, "embeddings"))


def op12_row_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_report(read_table(spark, sf_dir, "documents"))


def op13_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_report(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_classifier_chain, op2_paragraph_minhash, op3_token_range_coder, op4_tag_path_ratios, op5_line_first_cleaning,
    op6_kneser_ney_perplexity, op7_block_mixing, op8_parity_sketch_join, op9_line_run_dedup,
    op9_single_line_dedup, op10_latent_decontamination, op11_segment_filtering, op12_row_accumulation, op13_pair_index)}
ORACLES: dict[str, str] = {
    "op5_line_first_cleaning": line_quality.ORACLE,
    "op9_line_run_dedup": line_runs.ORACLE,
    "op9_single_line_dedup": line_runs.SINGLE_ORACLE,
    "op11_segment_filtering": segment_search.ORACLE,
    "op12_row_accumulation": divergence.ORACLE,
}
