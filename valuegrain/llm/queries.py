"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegrain.llm import (
    html_text,
    infill,
    lexical,
    mixing,
    packing,
    pii,
    quality,
    sharding,
    simhash,
    suffix_dedup,
    topk,
    url_filter,
    word_bpe,
)
from valuegrain.llm.oracles import ORACLES
from valuegrain.llm.tables import read_table


def op1_extendible_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = sharding.shard(read_table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "shard", "depth", F.col("bytes").alias("shard_bytes"), "fits")


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    return url_filter.judge_urls(pages, url_filter.fit_trees(url_filter.word_labels(pages)))


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(read_table(spark, folder, "pages"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, folder, "documents"))
    counts = [pii.count_kind(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, "base_sha256", "spans")


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeated_passages(read_table(spark, folder, "documents"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return quality.judge(docs, quality.fit_quality(docs, read_table(spark, folder, "labels"))).drop("score")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents")).drop("ids")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_products(read_table(spark, folder, "embeddings"), every=100)


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    near = simhash.near_duplicates(read_table(spark, folder, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_infill(spark: SparkSession, folder: str) -> DataFrame:
    arranged = infill.arrange(read_table(spark, folder, "documents"))
    kept = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
    return infill.restore(arranged, kept).drop("restored")


def op12_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = word_bpe.encode(read_table(spark, folder, "documents"))
    encoded = encoded.withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = word_bpe.decode(encoded, ("doc_id", "n_tokens", "ids_sha256"))
    return decoded.withColumn("decoded_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


QUERIES = {
    name: function
    for name, function in list(globals().items())
    if name.startswith("op") and name[2].isdigit()
}
