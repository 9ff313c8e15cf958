"""Snapshot retention: what to keep, why, and expiring the rest."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput
from .table import Table

DAY_MS = 86_400_000


@dataclass(frozen=True)
class RetentionOptions:
    """Fixed defaults: snapshots of the last 7 days and the newest 10 stay."""

    older_than_ms: int = 7 * DAY_MS
    retain_last: int = 10

    def __post_init__(self) -> None:
        if self.older_than_ms < 0 or self.retain_last < 0:
            raise InvalidInput("retention can't be negative")


def plan_retention(snapshots: DataFrame, now_ms: int, options: RetentionOptions = RetentionOptions()) -> DataFrame:
    """(snapshot_id, timestamp_ms, age_days, keep, reason) of each row of ``snapshots``.

    ``snapshots``: snapshot_id, timestamp_ms, is_current, refs (array).  The
    first reason counts: current, referenced, among the newest, recent; a
    snapshot without one is to be removed.
    """
    newest = Window.orderBy(F.desc("timestamp_ms"), F.desc("snapshot_id"))
    # Only the newest few are ranked, so no task sorts them all.
    top = snapshots.select("snapshot_id", "timestamp_ms").orderBy(F.desc("timestamp_ms"), F.desc("snapshot_id")).limit(options.retain_last).select("snapshot_id", F.row_number().over(newest).alias("rank"))
    rows = snapshots.join(top, "snapshot_id", "left")
    age = F.lit(now_ms) - F.col("timestamp_ms")
    reason = (
        F.when(F.col("is_current"), "current")
        .when(F.size("refs") > 0, "referenced")
        .when(F.col("rank").isNotNull(), "newest")
        .when(age < options.older_than_ms, "recent")
    )
    return rows.select("snapshot_id", "timestamp_ms", (age / DAY_MS).alias("age_days"), reason.isNotNull().alias("keep"), F.coalesce(reason, F.lit("expired")).alias("reason"))


def expire(table: Table, options: RetentionOptions = RetentionOptions(), now_ms: int | None = None, dry_run: bool = False) -> tuple[list[int], list[str]]:
    """Remove snapshots; returns their ids and the manifest lists that nothing refers to now (no file is deleted)."""
    snapshots = table.snapshots()
    plan = plan_retention(snapshots, int(time.time() * 1000) if now_ms is None else now_ms, options)
    gone = plan.where(~F.col("keep")).join(snapshots.select("snapshot_id", "manifest_list"), "snapshot_id").orderBy("snapshot_id").collect()
    ids = [r["snapshot_id"] for r in gone]
    if ids and not dry_run:
        table.catalog.expire_snapshots(table, ids)
    return ids, [r["manifest_list"] for r in gone]
