"""The registered queries: every operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import (bag_minhash, collocations, decontaminate, html_main, language, line_dedup, pieces, quality, sql, substring_dedup, suffix_dedup,
                           token_counts, token_files, vector_codes)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.mark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op7_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(_table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.PATTERN, 512)


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return pieces.digest(_table(spark, sf_dir, "documents"), public.path("piece_bpe_32k.model"))


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.groups(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents")).drop("place")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return token_files.digests(_table(spark, sf_dir, "documents"), public.path("word_bpe_49k.json"), 2)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_suffix_dedup, op2_decontaminate, op3_quality_rules, op4_line_dedup, op5_substring_dedup, op6_language, op7_html_main, op8_token_counts, op9_sentence_pieces, op10_bag_minhash,
    op11_collocations, op12_token_files, op13_vector_codes, pipeline)}
SQL = {"op1_suffix_dedup": sql.SUFFIXES, "op2_decontaminate": sql.LEAKS, "op4_line_dedup": sql.LINES, "op5_substring_dedup": sql.SUBSTRINGS,
       "op11_collocations": sql.COLLOCATIONS, "op13_vector_codes": sql.VECTOR_CODES}
