"""The registered queries of the text operators: opN_<name>(spark, sf_dir) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fuzzy_lines, html_main, license_scan, mixing, packing, pii, quality_crf, quality_rules, simhash_dedup
from .common import documents


def tokenizer_path() -> str:
    """Where the public tokenizers' byte-level BPE file is; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).drop("uid")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("spans")


def op6_html_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(documents(spark, sf_dir, "pages"))


def op7_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir)).drop("places")


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_crf.classify(docs, quality_crf.train(docs, documents(spark, sf_dir, "labels")))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.dedup_lines(documents(spark, sf_dir), grams=True)


def op10_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_pii_boosting, op3_exact_dedup, op4_best_fit_packing, op5_source_mixing,
        op6_html_differencing, op7_license_templates, op8_quality_crf, op9_fuzzy_lines, op10_simhash_pigeonring,
    )
}
ORACLE_SQL = {"op3_exact_dedup": exact_dedup.SQL}
