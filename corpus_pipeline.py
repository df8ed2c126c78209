"""The corpus pipeline: documents through five stages to token records.

Every stage takes all rows its predecessor kept, written as Parquet and read
again.  The first four return the columns of documents; the last returns, for
each written record, what reading its file back gives.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import mixing, ngram_join, quality, records, suffix_arrays
from stratagraph.llm.common import read, scratch, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of 0.7 or more)."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id; of rows that repeat an id those of
    one text are one document, other texts are judged on their own.  A document without an id stays."""
    keep = written(ngram_join.distinct_texts(docs), "keep").select(F.col("id").alias("_keep"), F.col("text_key").alias("_text"), F.col("class").alias("_class"))
    same = (docs["doc_id"] == keep["_keep"]) & (F.xxhash64(docs["text"]) == keep["_text"])
    kept = docs.where("doc_id is not null").join(keep, same)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "_class"])
    return kept.select(*docs.columns).union(docs.where("doc_id is null"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark text, or with so little that it is below the operator's share."""
    return suffix_arrays.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the tempered weights of their sources, in global random order."""
    return mixing.replicate(docs).select("doc.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of every row, in the mixed order: id, start, n_tokens, ids_crc32 as read back from the shards."""
    path = scratch(spark, "records")
    records.write_records(docs, path, public_tokenizers.path("byte_bpe_50k.json"), keep_order=True)
    return records.read_digests(spark, path).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("token_records", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A fitted model and hashed words aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
