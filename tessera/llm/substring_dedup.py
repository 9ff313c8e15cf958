"""Removal of word sequences that occur more than once, by a log-structured index.

Of every window of ``window`` words the smallest hash among its runs of ``gram``
words is the window's fingerprint (winnowing): equal windows have equal
fingerprints, and neighbouring windows mostly share one, so the index holds
about two rows per ``window - gram + 2`` words.  Each batch is written as an
immutable sorted run, merge-joined with the runs before it, and windows whose
fingerprint occurs at two places are then verified by SHA-256 of their words.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import BatchLog, by_bucket, cut, delete_path, fresh_path, release, settled
from .words import SPACES, Words, signed, words_of

WINDOW, GRAM = 35, 8
BUCKETS = 32
ROWS = "fp BIGINT, key BIGINT, n INT, attempt STRING"


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints: rows (fp, key, n, attempt).

    A row says that ``fp`` occurs ``n`` times in what one task read together,
    first in document ``key``.  Runs are the sorted files of a table bucketed by
    ``fp``, so joining a batch with all of history moves nothing but the batch.
    ``compact`` merges the runs into one once there are ``max_runs``.  Which
    documents hold fingerprints that occur twice in what one task read together
    is kept beside the runs, as the same pass saw it: (key, fps, attempt).

    ``path`` holds all there is, the number of buckets and the log of batches
    too: opening it continues the index.  Rows of attempts that aren't logged
    don't count, and compaction drops them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, max_runs: int = 8):
        self.spark, self.path, self.max_runs = spark, path, max_runs
        self.buckets, self.log = settled(spark, path, "buckets", buckets), BatchLog(spark, path)
        self._storage, self._names = self.log.storage, []
        whole = [n for n in self._storage.names(path, folders=True) if n.startswith("generation-") and self._storage.exists(f"{path}/{n}/_SUCCESS")]
        self._open(max((int(n.split("-")[1]) for n in whole), default=0))

    def _table(self, at: str) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} ({ROWS}) USING parquet "
            f"CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{at}'"
        )
        self._names.append(name)
        return name

    def _open(self, generation: int) -> None:
        self.generation, self.at = generation, f"{self.path}/generation-{generation}"
        self.name = self._table(self.at)

    def _logged(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("attempt").isin([e["attempt"] for e in self.log.entries()]))

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self._logged(self.spark.table(self.name))

    def runs(self) -> int:
        """Batches that this generation holds as runs of their own, besides what was compacted."""
        return len(self.log.entries()) - settled(self.spark, self.path, f"runs-{self.generation}", 0)

    def _write(self, rows: DataFrame, name: str, at: str) -> None:
        by_bucket(rows, self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp").format("parquet").mode("append").option("path", at).saveAsTable(name)

    def add(self, rows: DataFrame, batch: str) -> None:
        """Write what ``document_rows`` found, read once and written, as a new run; nothing if the batch is logged."""
        if self.log.attempt(batch) is None:
            attempt = uuid.uuid4().hex
            own = F.lit(attempt).alias("attempt")
            rows.where("size(fps) > 0").select("key", "fps", own).write.mode("append").parquet(f"{self.path}/twice")
            self._write(rows.selectExpr("key", "inline(own)").select("fp", "key", "n", own), self.name, self.at)
            self.log.add(batch, attempt)
        if self.runs() > self.max_runs:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one generation, then drop the old one."""
        # Read as plain files: known buckets would make Spark leave out the exchange that brings a bucket's runs together.
        rows, old = self._logged(self.spark.read.schema(ROWS).parquet(self.at)), self.at
        new = f"{self.path}/generation-{self.generation + 1}"
        delete_path(self.spark, new)  # what an earlier attempt may have left
        # What was compacted is one run with those that come.
        settled(self.spark, self.path, f"runs-{self.generation + 1}", len(self.log.entries()) - 1)
        self._write(rows, self._table(new), new)
        self._open(self.generation + 1)
        delete_path(self.spark, old)

    def repeated(self, batch: str | None = None) -> DataFrame:
        """(key, fp) of fingerprints that occur at two places or more, if given only those that occur in this batch."""
        totals = self.rows().groupBy("fp").agg(F.sum("n").alias("total"), F.max(F.col("attempt") == F.lit(self.log.attempt(batch) if batch else "")).alias("own")).where("total >= 2")
        totals = (totals.where("own") if batch else totals).select("fp")
        once = self.rows().where("n = 1").join(totals.hint("merge"), "fp").select("key", "fp")
        twice = self._logged(self.spark.read.schema("key bigint, fps array<bigint>, attempt string").parquet(f"{self.path}/twice")).select("key", F.explode("fps").alias("fp"))
        return once.unionByName(twice.join(totals, "fp").select("key", "fp") if batch else twice)

    def close(self) -> None:
        """Forget the session's names for the index; its files stay."""
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _sliding(x: np.ndarray, width: int, combine) -> np.ndarray:
    """combine(x[i:i+width]) for every i; beyond the end the last value repeats."""
    size, out = 1, x
    while size * 2 <= width:
        out = combine(out, np.concatenate([out[size:], out[-1:].repeat(min(size, len(out)))])[: len(out)])
        size *= 2
    rest = width - size
    if rest:
        out = combine(out, np.concatenate([out[rest:], out[-1:].repeat(min(rest, len(out)))])[: len(out)])
    return out


def window_fingerprints(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of ``gram`` words, each window's fingerprint, and whether a window starts there."""
    grams, _ = words.grams(gram)
    if not len(grams):
        return grams, grams, np.zeros(0, bool)
    per_text = np.diff(words.first)
    starts = np.arange(len(grams)) + window <= np.repeat(words.first[1:], per_text)
    return grams, _sliding(grams, window - gram + 1, np.minimum), starts


def _anchors(words: Words, window: int, gram: int) -> np.ndarray:
    """Words at which some window's fingerprint starts."""
    grams, prints, starts = window_fingerprints(words, window, gram)
    if not len(grams):
        return np.zeros(0, np.int64)
    of_windows = np.where(starts, prints, np.uint64(0))
    # A run of words that starts at i is in the windows i-span+1 .. i; it is the least of one if it equals the largest of their minima.
    span = window - gram + 1
    largest = _sliding(of_windows[::-1], span, np.maximum)[::-1]
    return np.flatnonzero((largest == grams) & (largest > 0))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for part, texts in slices(batches):
        yield part, [t.encode() for t in texts]


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(key, doc_id, text), and whether the key is doc_id: it is where ids are whole and unique.

    Otherwise it is a hash of id and text, so that rows of one id with other
    texts are told apart; rows repeated in both are separate places all the same.
    """
    narrow = docs.select("doc_id", "text")
    odd = narrow.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    key = F.xxhash64("doc_id", "text") if odd else F.col("doc_id")
    return narrow.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), not odd


def document_rows(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: words, digest of all of them, and fingerprints.

    ``own`` has (fp, n) for each fingerprint of what a task reads together that
    occurs there n times, and first in this document; ``fps`` are the document's
    fingerprints that occur there twice or more.  Only one and the same run of
    this may give both: another may read other rows together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches):
            words = words_of(texts, SPACES)
            at = _anchors(words, window, gram)
            fp = words.grams(gram)[0][at]
            _, first, inverse, n = np.unique(fp, return_index=True, return_inverse=True, return_counts=True)
            twice = n[inverse] > 1
            lists = lambda chosen, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(at[chosen], words.first).astype(np.int32)), values)
            order = np.argsort(first)
            own = pa.StructArray.from_arrays([pa.array(signed(fp[first[order]])), pa.array(n[order].astype(np.int32))], ["fp", "n"])
            whole = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
            columns = [part.column(0), part.column(1), pa.array(np.diff(words.first)), pa.array(whole), lists(first[order], own), lists(twice, pa.array(signed(fp[twice])))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "n_words", "whole_sha256", "own", "fps"])

    return rows.mapInArrow(run, "key bigint, doc_id bigint, n_words bigint, whole_sha256 string, own array<struct<fp: bigint, n: int>>, fps array<bigint>")


def _verify(candidates: DataFrame, window: int, gram: int) -> DataFrame:
    """Windows (h, check, key, start, n) of candidate fingerprints; n of them in this task, n = 0: known to be repeated.

    h and check are 96 bits of SHA-256 of the window's words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches):
            words = words_of(texts, SPACES)
            _, prints, starts = window_fingerprints(words, window, gram)
            wanted = np.unique(part.column(2).flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
            at = np.flatnonzero(starts)
            at = at[np.isin(prints[at], wanted)]
            if not len(at):
                continue
            digests = b"".join([hashlib.sha256(x).digest()[:12] for x in words.sequences(at, window)])
            parts = np.frombuffer(digests, "<u4").reshape(-1, 3)
            h = (parts[:, 0].astype(np.uint64) << np.uint64(32)) | parts[:, 1]
            check = parts[:, 2].astype(np.uint32).view(np.int32)
            order = np.lexsort((check, h))
            h, check, at = h[order], check[order], at[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
            group = np.cumsum(new) - 1
            n = np.bincount(group)[group]
            of = words.text_of_word()[at]
            keys, start = part.column(0).take(pa.array(of)), (at - words.first[of]).astype(np.int32)
            names = ["h", "check", "key", "start", "n"]
            one = np.flatnonzero(new)  # one row of each goes to the other tasks
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[one])), pa.array(check[one]), keys.take(pa.array(one)), pa.array(start[one]), pa.array(n[one].astype(np.int32))], names)
            known = np.flatnonzero(n > 1)
            if len(known):
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[known])), pa.array(check[known]), keys.take(pa.array(known)), pa.array(start[known]), pa.array(np.zeros(len(known), np.int32))], names)

    return candidates.select("key", "text", "fps").mapInArrow(run, "h bigint, check int, key bigint, start int, n int")


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """(key, start) of windows that start anywhere else too.

    Rows of one window meet in one partition, at most one from each slice of
    text that held it, and are compared with their neighbours in sorted order;
    nothing of a group is held in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row: (h, check, n, key, start, whether it is known to repeat)
        for batch in batches:
            if not len(batch):
                continue
            h, check, start, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            key = batch.column(2)
            as_before = np.concatenate([[False], (h[1:] == h[:-1]) & (check[1:] == check[:-1])])
            as_before[0] = held is not None and held[0] == h[0] and held[1] == check[0]
            as_after = np.concatenate([as_before[1:], [False]])
            if held is not None and not held[5] and as_before[0] and held[2] == 1:
                yield pa.RecordBatch.from_arrays([pa.array([held[3]], pa.int64()), pa.array([held[4]], pa.int32())], ["key", "start"])
            # A slice's own repeats (n > 1) have rows of their own with n = 0, which always stand.
            out = np.flatnonzero((n == 0) | (n == 1) & (as_before | as_after))
            yield pa.RecordBatch.from_arrays([key.take(pa.array(out)), pa.array(start[out])], ["key", "start"])
            held = (h[-1], check[-1], n[-1], key[-1].as_py(), start[-1], bool(as_before[-1]))

    dealt = windows.withColumn("to", F.when(F.col("n") == 0, F.xxhash64("key", "start")).otherwise(F.col("h")))
    return dealt.repartition("to").drop("to").sortWithinPartitions("h", "check").mapInArrow(run, "key bigint, start int")


def _remove(found: DataFrame, window: int) -> DataFrame:
    """(key, n_removed, kept_sha256) from (key, text, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches):
            removed, digests = [], []
            for text, starts in zip(texts, part.column(2), strict=True):
                words = text.split()
                step = np.zeros(len(words) + 1, np.int32)
                begin = np.unique(starts.values.to_numpy())
                np.add.at(step, begin, 1)
                np.add.at(step, np.minimum(begin + window, len(words)), -1)
                gone = np.cumsum(step[:-1]) > 0
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["key", "n_removed", "kept_sha256"])

    return found.select("key", "text", "starts").mapInArrow(run, "key bigint, n_removed bigint, kept_sha256 string")


def add_batch(rows: DataFrame, index: FingerprintIndex, batch: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Add ``rows`` (key, doc_id, text) to ``index`` as a batch; (key, doc_id, n_words, whole_sha256) of each."""
    spark, at = rows.sparkSession, fresh_path(rows.sparkSession, "fingerprinted")
    document_rows(rows, window, gram).write.parquet(at)
    passed = spark.read.parquet(at)
    index.add(passed, batch)
    per_doc = cut(passed.select("key", "doc_id", "n_words", "whole_sha256"))
    delete_path(spark, at)
    release(spark)
    return per_doc


def judge(texts: DataFrame, per_doc: DataFrame, index: FingerprintIndex, batch: str | None = None, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove from the documents of ``per_doc`` what the index holds twice.

    ``texts`` are (key, text) of all that the index holds; with ``batch`` only
    what that batch shares is looked at.
    """
    spark, n = texts.sparkSession, index.buckets
    candidates = index.repeated(batch).groupBy("key").agg(F.collect_set("fp").alias("fps"))
    at, name = fresh_path(spark, "candidates"), f"candidates_{uuid.uuid4().hex}"
    # The texts move once: what is joined here is kept bucketed by key for the removal.
    texts.repartition(n, "key").join(candidates.hint("merge"), "key").select("key", "text", "fps").write.bucketBy(n, "key").format("parquet").option("path", at).saveAsTable(name)
    release(spark)
    found = spark.table(name)
    starts = _repeated_windows(_verify(found, window, gram)).groupBy("key").agg(F.collect_set("start").alias("starts"))
    removed = cut(_remove(found.select("key", "text").join(starts.hint("merge"), "key"), window).dropDuplicates(["key"]))
    release(spark)
    result = cut(
        per_doc.join(removed, "key", "left").select(
            "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256")
        )
    )
    spark.sql(f"DROP TABLE {name}")
    delete_path(spark, at)
    return result


def substring_dedup(docs: DataFrame, index: FingerprintIndex, history: DataFrame | None = None, window: int = WINDOW, gram: int = GRAM, batch: str | None = None) -> DataFrame:
    """Add a batch to ``index`` and judge it against itself and against history.

    Returns one row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.
    A word goes if a window of ``window`` consecutive words of one document
    covers it whose word sequence also starts anywhere else: at another place of
    the same document, in another row (a repeated row too), or in ``history``,
    the documents of earlier batches.  Of these only documents that share a
    fingerprint with the batch are read by words.

    ``batch`` names the batch; one that is given again, because its driver
    failed, isn't added twice.

    A null text has no words, and an empty or short one no windows.  A null
    doc_id is a document of its own.  Repeated rows are places of their own: of
    a text of at least ``window`` words that occurs twice, nothing is kept.  An
    empty table gives no rows.  Further columns are ignored.
    """
    batch = batch or uuid.uuid4().hex
    rows, _ = keyed(docs)
    per_doc = add_batch(rows, index, batch, window, gram)
    texts = rows.select("key", "text")
    if history is not None:
        texts = texts.unionByName(keyed(history)[0].select("key", "text"))
    return judge(texts, per_doc, index, batch, window, gram)


def dedup_in_batches(docs: DataFrame, index: FingerprintIndex, batches: int = 2, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``substring_dedup`` of a whole table that reaches ``index`` in several batches and is judged when all are there."""
    rows, _ = keyed(docs)
    own = F.pmod(F.xxhash64("key"), F.lit(batches))
    per_doc = None
    for i in range(batches):
        one = add_batch(rows.where(own == i), index, f"part {i}", window, gram)
        per_doc = one if per_doc is None else per_doc.unionByName(one)
    return judge(rows.select("key", "text"), per_doc, index, None, window, gram)


def new_index(spark: SparkSession, buckets: int = BUCKETS, max_runs: int = 8) -> FingerprintIndex:
    """An empty index in the shared folder."""
    return FingerprintIndex(spark, fresh_path(spark, "fingerprints"), buckets, max_runs)
