"""From raw documents to packed training windows, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame. Its result
is written as Parquet to the shared folder and read again as the next stage's docs, so a lost executor never costs more
than the stage it was in. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.llm._scratch import drop, keep, run_folder
from scanweave.llm.language import identified_only
from scanweave.llm.line_dedup import deduplicated
from scanweave.llm.near_dedup import near_dedup
from scanweave.llm.packing import pack
from scanweave.llm.quality import kept_only


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no learned language. Null texts and texts without a letter go; the best language of equal ones
    is the first by name, which does not matter for staying."""
    return identified_only(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the rules' joint verdict reject. Null and empty texts have no words and go; a posterior
    of exactly one half stays."""
    return kept_only(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that a document of smaller doc_id holds out of the texts; n_chars follows the text. Null texts stay null, and rows
    of a null doc_id stay whole."""
    return deduplicated(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    37 bands of 5 slots miss a pair at similarity 0.8 as a candidate with probability (1 - 0.8^5)^37 = 4e-7.

    Rows that repeat both doc_id and text are one document, and one of them stays. Rows of a null doc_id take no part and
    all stay. A doc_id names one document: where its rows have different texts, all go if one is a copy of a smaller doc_id,
    else each text stays once.
    """
    gone = near_dedup(docs, percent=80, bands=37).where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.limit(1).count():
        return left
    repeated = keep(repeated, "near-repeated")
    once = left.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 4096 tokens. A null text is a document of the end id alone; a null doc_id stays null."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("packing", packing)]
#: SQL can't express the learned stages; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row. The last one's result is not written here; the tables it reads stay until the caller deletes them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *stages, (_, last) = STAGES
    for name, stage in stages:
        with run_folder(spark) as folder:
            docs_after = stage(spark, docs, sf_dir)
        docs = keep(docs_after, f"pipeline-{name}")
        drop(spark, folder)
    return last(spark, docs, sf_dir)
