"""One query per operator over its whole table, as (spark, sf_dir) -> DataFrame, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.llm import ann, warc
from scanweave.llm._scratch import fresh
from scanweave.llm.bpe import round_trip
from scanweave.llm.chat import format_chats, read_back
from scanweave.llm.language import identify
from scanweave.llm.license import license_scan, license_sql
from scanweave.llm.line_dedup import line_dedup
from scanweave.llm.near_dedup import near_dedup
from scanweave.llm.negatives import hard_negatives, negatives_sql
from scanweave.llm.packing import pack
from scanweave.llm.quality import quality
from scanweave.llm.sharding import read_shards, write_shards
from scanweave.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").selectExpr("conv_id", "cast(turn as long) as turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(extra), public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return hard_negatives(vectors.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = _table(spark, sf_dir, "documents"), fresh(spark, "shards")
    write_shards(docs, folder)
    rows = read_shards(docs, folder)
    return rows.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_quality, op3_bpe, op4_chat, op5_warc, op6_ann, op7_packing, op8_license, op9_language, op10_line_dedup, op11_whitening, op12_hard_negatives, op13_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op8_license": license_sql(), "op12_hard_negatives": negatives_sql()}
