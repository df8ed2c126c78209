"""Queries opN_<name>: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import chat, licences, mixing, ngram_join, quality, records, rotated_codes, site_templates, suffix_arrays, toxicity
from stratagraph.llm.common import read, scratch, written


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "records")
    records.write_records(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return records.read_digests(spark, path).withColumnRenamed("id", "doc_id")


def op2_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.search(read(spark, sf_dir, "embeddings"))


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.extract(read(spark, sf_dir, "pages"))


def op8_template_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(read(spark, sf_dir, "documents")).drop("matches").withColumnRenamed("id", "doc_id")


def op9_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op10_chat_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_digests(written(chat.format_conversations(turns.unionByName(more)), "conversations"))


QUERIES = {f.__name__: f for f in (op1_token_records, op2_boosted_quality, op3_ngram_join, op4_rotated_codes, op5_compression_toxicity, op6_poisson_mix, op7_site_templates, op8_template_licences, op9_suffix_arrays, op10_chat_templates)}

ORACLE = {
    "op6_poisson_mix": mixing.MIX_SQL.format(
        docs="SELECT * FROM documents",
        select="doc_id, text, lang, source, n_chars, c AS copy, md5('shuffle17|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(c AS VARCHAR)) AS shuffle_key",
    ),
}
