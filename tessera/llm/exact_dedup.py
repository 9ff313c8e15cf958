"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest.  A batch is first
reduced to one row per digest (with map-side combine, so a text that makes up a
third of the rows costs one row per map task), then joined to the index by a
sort-merge join in which only the batch moves, and what is new is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BatchLog, ascii_lower, by_bucket, cut, fresh_path, settled

BUCKETS = 32


class DigestIndex:
    """SHA-256 digests of all texts seen so far, with the id of the row that stays.

    ``path`` holds all there is (bucketed Parquet files, the number of buckets
    and the log of batches), so an index outlives the session: opening the path
    continues it.  Choose ``buckets`` for the final size (a bucket is what one
    join task reads; ``common.buckets_for`` estimates it).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        self.buckets, self.log = settled(spark, path, "buckets", buckets), BatchLog(spark, path)
        self.name, self.at = f"digest_index_{uuid.uuid4().hex}", f"{path}/digests"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, attempt STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.at}'"
        )

    def rows(self, attempts: list[str] | None = None) -> DataFrame:
        """Rows of these attempts, by default of all that are logged."""
        self.spark.catalog.refreshTable(self.name)
        wanted = [e["attempt"] for e in self.log.entries()] if attempts is None else attempts
        return self.spark.table(self.name).where(F.col("attempt").isin(wanted))

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add rows (digest, keep_id) of a batch and log it; each bucket gets one sorted file a batch."""
        attempt = uuid.uuid4().hex
        (
            by_bucket(groups.select("digest", "keep_id", F.lit(attempt).alias("attempt")), self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .format("parquet")
            .mode("append")
            .option("path", self.at)
            .saveAsTable(self.name)
        )
        self.log.add(batch, attempt)

    def close(self) -> None:
        """Forget the session's name for the index; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row: SHA-256 of the text with A-Z lower-cased."""
    return docs.select("doc_id", F.unhex(F.sha2(ascii_lower(docs["text"]).cast("binary"), 256)).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Judge a batch against itself and against ``index``, then append what is new.

    Returns one row per row of ``docs``: doc_id, digest (binary), keep_id,
    group_size (rows of this batch with that text), seen (an earlier batch had
    the text) and kept.  Of equal texts in a batch the row with the largest
    doc_id stays; a text that the index has already keeps the earlier id.

    ``batch`` names the batch.  The same batch given again, because its driver
    or what came after it failed, is judged by the batches before it and gives
    the same result; it isn't appended twice.

    A null text counts as empty, and empty texts equal one another.  A null
    doc_id sorts below every other.  Rows that repeat doc_id and text are told
    apart: exactly one row of a group is kept.  An empty table gives no rows.
    Further columns of ``docs`` are ignored, whatever their names.
    """
    batch = batch or uuid.uuid4().hex
    rows = cut(digests(docs).withColumn("row", F.monotonically_increasing_id()))
    groups = cut(
        rows.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top"))
        .select("digest", "group_size", F.col("top.doc_id").alias("top_id"), F.col("top.row").alias("top_row"))
    )
    # The index is bucketed by digest: only the batch moves.
    earlier = index.rows(index.log.before(batch))
    if index.log.attempt(batch) is None:
        fresh = cut(groups.join(earlier.select("digest").hint("merge"), "digest", "left_anti").select("digest", F.col("top_id").alias("keep_id")))
    known = earlier.hint("merge").select("digest", F.col("keep_id").alias("earlier_id"), F.lit(True).alias("seen"))
    judged = cut(groups.join(known, "digest", "left").withColumn("seen", F.coalesce("seen", F.lit(False))))
    if index.log.attempt(batch) is None:
        index.append(fresh, batch)
    # Both inputs of this join are plain exchanges: adaptive execution splits the partition of a hot digest.
    return rows.join(judged, "digest").select(
        "doc_id",
        "digest",
        F.when(F.col("seen"), F.col("earlier_id")).otherwise(F.col("top_id")).alias("keep_id"),
        "group_size",
        "seen",
        (~F.col("seen") & (F.col("row") == F.col("top_row"))).alias("kept"),
    )


def new_index(spark: SparkSession, buckets: int = BUCKETS) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, fresh_path(spark, "digest-index"), buckets)


def exact_dedup_in_batches(docs: DataFrame, index: DigestIndex, batches: int = 3) -> DataFrame:
    """``exact_dedup`` of a whole table, dealt to ``index`` in several batches: the same columns without ``seen``.

    Batches are ranges of doc_id, largest ids first, so the row that an earlier
    batch kept is that with the largest doc_id of all; group_size counts rows of
    all batches.  Null ids come last, with the smallest.  An empty table gives
    no rows.
    """
    ends = docs.agg(F.percentile_approx("doc_id", [1 - i / batches for i in range(1, batches)])).first()[0] or []
    found, above = None, None
    for i, least in enumerate([*ends, None]):
        part = docs if least is None else docs.where(F.col("doc_id") > least)
        part = part if above is None else part.where(F.coalesce(F.col("doc_id") <= above, F.lit(True)))
        above = least
        judged = exact_dedup(part, index, f"range {i}")
        found = judged if found is None else found.unionByName(judged)
    found = cut(found.drop("group_size", "seen"))
    sizes = cut(found.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")))
    return found.join(sizes, "digest").select("doc_id", "digest", "keep_id", "group_size", "kept")
