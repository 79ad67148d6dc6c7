"""A corpus pipeline: quality rules, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes each stage's result as
Parquet in the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valuegrain.llm.mixing import apply_mix
from valuegrain.llm.packing import pack
from valuegrain.llm.pii import redact_pii
from valuegrain.llm.quality import fit_quality, keep_good
from valuegrain.llm.simhash import drop_near_duplicates
from valuegrain.llm.tables import read_table, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the model's threshold go."""
    return keep_good(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind."""
    return redact_pii(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokens with their places in training sequences."""
    return pack(docs).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("packing", packing),
]

#: Tokens and fingerprints have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
