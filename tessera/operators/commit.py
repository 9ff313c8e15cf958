"""Transactions: queued appends and rewrites become one snapshot, tried again when another came first."""

from __future__ import annotations

import json
import secrets
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConcurrentModification, InvalidInput, NothingToCommit
from ..sources.footer import ADDED, DELETED, EXISTING
from .metadata import Metadata, Snapshot

ATTEMPTS = 3


@dataclass
class Transaction:
    table: object
    added: list[DataFrame] = field(default_factory=list)
    dropped: list[DataFrame] = field(default_factory=list)

    def append(self, files: DataFrame) -> Transaction:
        """Queue inventory rows of new files."""
        self.added.append(files)
        return self

    def rewrite(self, dropped: DataFrame, files: DataFrame) -> Transaction:
        """Queue the replacement of files (column file_path) by others."""
        self.dropped.append(dropped.select("file_path"))
        self.added.append(files)
        return self

    def commit(self, timestamp_ms: int | None = None, attempts: int = ATTEMPTS, summary: dict[str, str] | None = None) -> Snapshot:
        if not self.added and not self.dropped:
            raise NothingToCommit("no operation is queued")
        for attempt in range(attempts):
            try:
                return self._try(timestamp_ms, summary or {})
            except ConcurrentModification:
                if attempt == attempts - 1:
                    raise
                self.table.refresh()
        raise AssertionError

    def _union(self, frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _try(self, timestamp_ms: int | None, summary: dict[str, str]) -> Snapshot:
        table, storage = self.table, self.table.catalog.storage
        meta: Metadata = table.metadata
        parent = meta.current
        taken = {s.snapshot_id for s in meta.snapshots}
        snapshot_id = secrets.randbits(62) + 1
        while snapshot_id in taken:
            snapshot_id = secrets.randbits(62) + 1
        sequence = meta.last_sequence_number + 1
        written, published = [], False

        def write(rows: DataFrame, sequence_number: int, owner: int) -> dict | None:
            """One manifest, or nothing for no rows; its totals are read back from what was written."""
            at = f"{meta.location}/metadata/manifest-{uuid.uuid4()}"
            written.append(at)
            rows.withColumn("manifest", F.lit(at)).write.parquet(at)
            counts = {r["status"]: r for r in table.spark.read.parquet(at).groupBy("status").agg(F.count("*").alias("files"), F.sum("record_count").alias("rows"), F.sum("file_size_in_bytes").alias("bytes")).collect()}
            if not counts:
                storage.delete(written.pop())
                return None
            total = lambda status, what: int(counts[status][what] or 0) if status in counts else 0
            names = {ADDED: "added", EXISTING: "existing", DELETED: "deleted"}
            return {"manifest-path": at, "sequence-number": sequence_number, "added-snapshot-id": owner} | {f"{n}-{what}": total(s, what) for s, n in names.items() for what in ("files", "rows", "bytes")}

        try:
            manifests = table.manifest_list(parent) if parent else []
            kept, deleted, replaced = [], {"files": 0, "rows": 0, "bytes": 0}, []
            if self.dropped:
                drop = self._union(self.dropped).distinct()
                live = table.files_with_stats() if parent else None
                wanted = drop.count()
                if live is None or live.join(drop, "file_path", "left_semi").count() != wanted:
                    # Someone else has rewritten them, or they never were here: nothing may be lost or doubled.
                    raise ConcurrentModification("files to be replaced aren't in the table any more") if parent else InvalidInput("the table has no files to replace")
                touched = {r[0] for r in live.join(drop, "file_path", "left_semi").select("manifest").distinct().collect()}
            else:
                touched = set()
            for m in manifests:
                if m["manifest-path"] not in touched:
                    if m["added-files"] + m["existing-files"]:
                        kept.append(m)
                    continue
                rows = table.spark.read.parquet(m["manifest-path"]).where(F.col("status") != DELETED)
                gone = rows.join(drop, "file_path", "left_semi").agg(F.count("*"), F.sum("record_count"), F.sum("file_size_in_bytes")).first()
                deleted = {k: deleted[k] + int(v or 0) for k, v in zip(deleted, gone, strict=True)}
                rest = rows.join(drop, "file_path", "left_anti").withColumns(
                    {"status": F.lit(EXISTING), "snapshot_id": F.coalesce("snapshot_id", F.lit(m["added-snapshot-id"])), "sequence_number": F.coalesce("sequence_number", F.lit(m["sequence-number"]))}
                )
                if fresh := write(rest, m["sequence-number"], m["added-snapshot-id"]):
                    replaced.append(fresh)
            if self.dropped and deleted["files"] != wanted:
                raise ConcurrentModification(f"{wanted} files are to be replaced, {deleted['files']} were found")
            added = {"files": 0, "rows": 0, "bytes": 0}
            if self.added:
                rows = self._union(self.added).withColumns({"status": F.lit(ADDED), "snapshot_id": F.lit(snapshot_id), "sequence_number": F.lit(sequence)})
                if fresh := write(rows, sequence, snapshot_id):
                    added = {k: fresh[f"added-{k}"] for k in added}
                    kept.append(fresh)
            if not added["files"] and not deleted["files"]:
                raise NothingToCommit("no file is added or removed")
            manifests = [*replaced, *kept]
            count = lambda what: sum(m[f"added-{what}"] + m[f"existing-{what}"] for m in manifests)
            facts = {"operation": "replace" if self.dropped else "append", "added-data-files": added["files"], "added-records": added["rows"], "added-files-size": added["bytes"]}
            if deleted["files"]:
                facts |= {"deleted-data-files": deleted["files"], "deleted-records": deleted["rows"], "removed-files-size": deleted["bytes"]}
            facts |= {"total-data-files": count("files"), "total-records": count("rows"), "total-files-size": count("bytes")}
            listing = f"{meta.location}/metadata/snap-{snapshot_id}-{uuid.uuid4()}.json"
            storage.create(listing, json.dumps(manifests))
            written.append(listing)
            now = timestamp_ms if timestamp_ms is not None else int(time.time() * 1000)
            made = Snapshot(snapshot_id, parent.snapshot_id if parent else None, sequence, now, listing, {k: str(v) for k, v in (facts | summary).items()}, meta.current_schema_id)
            new = meta.with_snapshot(made)
            published = True  # unless it turns out that another came first, nobody can tell from here on
            try:
                path = table.catalog.replace_metadata(table, new)
            except ConcurrentModification:
                published = False
                raise
            table.metadata, table.metadata_path = new, path
            return made
        except Exception:
            if not published:  # nothing refers to what was written
                for at in written:
                    storage.delete(at)
            raise
