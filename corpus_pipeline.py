"""The corpus pipeline: classify, dedup, near-dedup, mix and pack the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatile.llm import common, exact_dedup, mixing, packing, quality_crf, simhash_dedup
from lumatile.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts stay. It is fitted to labelled rows of the stage's input."""
    common.release()
    docs = docs.select(*COLUMNS)
    return quality_crf.accepted(docs, quality_crf.train(docs, common.documents(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each content stays."""
    common.release()
    return exact_dedup.exact_dedup(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    common.release()
    return simhash_dedup.one_of_each(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that each source's quota takes: a row for each time a document is taken, n_chars as of its text."""
    common.release()
    return mixing.mixed(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; see packing.pack for the columns."""
    common.release()
    return packing.pack(docs.select(*COLUMNS), tokenizer_path())


STAGES = [("quality_crf", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("source_mixing", mix), ("best_fit_packing", pack)]

#: Learned scores, seeded choices and subword ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's rows written and read again."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    common.release()
    return docs
