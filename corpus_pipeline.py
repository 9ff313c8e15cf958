"""The corpus pipeline: toxicity, exact dedup, near dedup, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of documents, whatever else they
are called besides doc_id and text.  No stage fails on null ids or texts, empty
or very long texts, repeated rows or an empty table; what each does with them is
said at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, ngram_join, packing, pii, toxicity
from tessera.llm.common import buckets_for, cut, delete_path, fresh_path, keep_ids, table, unused


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier (op 6) predicts to be harmless.

    Rows are judged by their texts alone, a null one as an empty one; repeated
    rows stay or go together, and without labels all stay.
    """
    score = unused(docs, "score")["score"]
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def _judged_by_row(docs: DataFrame, first: Column, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``docs`` that ``judge`` keeps by doc_id; rows of repeated or null ids are numbered, in the order ``first``, and judged by that."""
    if not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        return keep_ids(docs, judge(docs))
    row, at = unused(docs, "row")["row"], fresh_path(docs.sparkSession, "rows")
    docs.orderBy(first, F.xxhash64("text")).withColumn(row, F.monotonically_increasing_id()).write.parquet(at)
    rows = docs.sparkSession.read.parquet(at)
    kept = judge(rows.select(F.col(row).alias("doc_id"), "text"))
    result = cut(rows.join(kept.toDF(row), row, "left_semi").select(docs.columns))
    delete_path(docs.sparkSession, at)
    return result


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that with the largest doc_id (op 10).

    A null text equals an empty one, so one of all these stays.  Null ids are
    the smallest; of rows with one id and text one stays.
    """

    def judge(rows: DataFrame) -> DataFrame:
        index = exact_dedup.new_index(spark, buckets_for(docs))
        kept = cut(exact_dedup.exact_dedup(rows, index).where("kept").select("doc_id"))
        index.close()
        delete_path(spark, index.path)
        return kept

    return _judged_by_row(docs, F.asc_nulls_first("doc_id"), judge)


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join one row, that with the smallest doc_id (op 9).

    Documents without words, null texts too, link with none and all stay.  Null
    ids are the largest; of rows with one id in a group one stays.
    """

    def judge(rows: DataFrame) -> DataFrame:
        found = ngram_join.ngram_components(rows)
        return found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")

    return _judged_by_row(docs, F.asc_nulls_last("doc_id"), judge)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data (op 8) gives way to its kind in brackets; n_chars, where there is one, follows the text.

    A null text stays null, with its n_chars; all rows stay, repeated ones alike.
    """
    redacted = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    return redacted.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens (op 5): a row for each piece.

    A null or empty text is one token, its end; repeated rows are packed as
    often as they occur, null ids stay null, an empty table gives no pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", distinct_texts),
    ("ngram_join", near_distinct),
    ("pii", without_personal_data),
    ("packing", packed),
]
#: The classifier, the estimates and the packing have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    at = ""
    for name, stage in STAGES:
        before, at = at, fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            delete_path(spark, before)
    docs = cut(docs)
    delete_path(spark, at)
    return docs
