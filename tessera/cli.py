"""Command line: catalog, namespace, table, snapshot, compact and commit, as text or JSON."""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidFile, TableError
from .operators.catalog import FolderCatalog
from .operators.compact import CompactOptions, compact_table, plan_compaction, plan_totals
from .operators.register import RegisterOptions, parse_values, partition_summary, register, upload
from .operators.retention import DAY_MS, RetentionOptions, expire, plan_retention
from .operators.table import ADD_FIELDS, REJECT


def bytes_text(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if abs(n) < 1024 or unit == "TiB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    raise AssertionError


def number_text(n: int) -> str:
    return f"{n:,}"


def percent_text(x: float) -> str:
    return f"{x:.1f}%"


def show(rows: DataFrame | list[dict] | dict, as_json: bool) -> str:
    """Rows as JSON or as an aligned table; listings of files are bounded by what the user asked to see."""
    one = isinstance(rows, dict)
    found = [rows] if one else [r.asDict(recursive=True) for r in rows.collect()] if isinstance(rows, DataFrame) else rows
    if as_json:
        return json.dumps(found[0] if one else found, indent=2, default=str)
    if one:
        return "\n".join(f"{k}: {v}" for k, v in found[0].items())
    if not found:
        return "(none)"
    names = list(found[0])
    cells = [names, *([str(r[n]) for n in names] for r in found)]
    widths = [max(len(row[i]) for row in cells) for i in range(len(names))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in cells)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    top.add_argument("--warehouse", required=True)
    top.add_argument("--json", action="store_true")
    groups = top.add_subparsers(dest="group", required=True)
    groups.add_parser("catalog").add_subparsers(dest="action", required=True).add_parser("info")
    namespace = groups.add_parser("namespace").add_subparsers(dest="action", required=True)
    namespace.add_parser("list")
    namespace.add_parser("create").add_argument("name")
    table = groups.add_parser("table").add_subparsers(dest="action", required=True)
    table.add_parser("list").add_argument("namespace")
    table.add_parser("info").add_argument("table")
    files = table.add_parser("files")
    files.add_argument("table")
    files.add_argument("--partition", help="key=value folder that paths must have")
    scan = table.add_parser("scan")
    scan.add_argument("table")
    scan.add_argument("--filter", default="")
    scan.add_argument("--limit", type=int, default=0, help="rows to print; 0: counts only")
    snapshot = groups.add_parser("snapshot").add_subparsers(dest="action", required=True)
    snapshot.add_parser("list").add_argument("table")
    cleanup = snapshot.add_parser("cleanup")
    cleanup.add_argument("table")
    cleanup.add_argument("--older-than-days", type=float, default=7)
    cleanup.add_argument("--retain-last", type=int, default=10)
    cleanup.add_argument("--dry-run", action="store_true")
    compact = groups.add_parser("compact")
    compact.add_argument("table")
    compact.add_argument("--target-mib", type=int, default=256)
    compact.add_argument("--max-input-mib", type=int, default=128)
    compact.add_argument("--min-files", type=int, default=3)
    compact.add_argument("--partition")
    compact.add_argument("--dry-run", action="store_true")
    compact.add_argument("--allow-partial", action="store_true")
    commit = groups.add_parser("commit")
    commit.add_argument("table")
    commit.add_argument("pattern")
    commit.add_argument("--create", action="store_true")
    commit.add_argument("--partition-spec", default="")
    commit.add_argument("--partition-values", default="")
    commit.add_argument("--add-fields", action="store_true")
    commit.add_argument("--allow-noop", action="store_true")
    commit.add_argument("--upload", action="store_true", help="copy local files into the table's data folder first")
    return top


def local_files(pattern: str) -> list[str]:
    """Parquet files on this machine that a path or glob names."""
    found = [f for p in glob.glob(pattern) for f in ([p] if os.path.isfile(p) else glob.glob(f"{glob.escape(p)}/**/*.parquet", recursive=True))]
    if not found:
        raise InvalidFile(f"no Parquet files match {pattern}")
    return sorted(os.path.abspath(f) for f in found)


def run(spark: SparkSession, argv: list[str]) -> str:
    """Do what ``argv`` says; returns what is printed."""
    a = parser().parse_args(argv)
    catalog = FolderCatalog(spark, a.warehouse)
    say = lambda x: show(x, a.json)
    if a.group == "catalog":
        return say({"kind": "folder", "warehouse": catalog.warehouse, "namespaces": catalog.list_namespaces().count()})
    if a.group == "namespace":
        if a.action == "list":
            return say(catalog.list_namespaces())
        catalog.create_namespace(a.name)
        return say({"created": a.name})
    if a.group == "table" and a.action == "list":
        return say(catalog.list_tables(a.namespace))
    if a.group == "commit":
        pattern = [upload(catalog.load_table(a.table), p) for p in local_files(a.pattern)] if a.upload else a.pattern
        done = register(catalog, a.table, pattern, RegisterOptions(not a.create, ADD_FIELDS if a.add_fields else REJECT, a.allow_noop), a.partition_spec, parse_values(a.partition_values) or None)
        summary = [] if done.snapshot is None else [r.asDict() for r in partition_summary(catalog.load_table(a.table).files_with_stats().where(F.coalesce("snapshot_id", F.lit(0)) == done.snapshot.snapshot_id)).collect()]
        return say({"added_files": done.added_files, "added_records": done.added_records, "skipped": done.skipped, "snapshot": done.snapshot and done.snapshot.snapshot_id, "partitions": summary})
    table = catalog.load_table(a.table)
    if a.group == "table" and a.action == "info":
        n = table.totals().first()
        return say({"table": a.table, "location": table.metadata.location, "schema": {f.name: f.type for f in table.schema.fields}, "partitions": [f.json() for f in table.spec], "snapshot": table.metadata.current_snapshot_id, "files": number_text(n["n_files"]), "size": bytes_text(n["n_bytes"]), "records": number_text(n["n_records"])})
    if a.group == "table" and a.action == "files":
        found = table.files()
        return say(found.where(F.array_contains(F.split("file_path", "/"), a.partition)) if a.partition else found)
    if a.group == "table":
        if a.limit:
            return say(table.scan(a.filter).limit(a.limit))
        n = table.plan(a.filter).first()
        return say({"files_kept": n["kept"], "files_total": n["total"], "pruned": percent_text(n["pruned_percent"])})
    if a.group == "snapshot" and a.action == "list":
        return say(table.snapshots().orderBy(F.desc("timestamp_ms")).select("snapshot_id", "timestamp_ms", "operation", "refs", "is_current"))
    if a.group == "snapshot":
        options = RetentionOptions(int(a.older_than_days * DAY_MS), a.retain_last)
        if a.dry_run:
            import time

            return say(plan_retention(table.snapshots(), int(time.time() * 1000), options))
        ids, lists = expire(table, options)
        return say({"expired": ids, "orphaned_manifest_lists": lists})
    options = CompactOptions(a.target_mib << 20, a.max_input_mib << 20, a.min_files, max(a.target_mib << 20, 512 << 20), a.partition, a.dry_run, a.allow_partial)
    if a.dry_run:
        return say(plan_totals(plan_compaction(table.files(), options), options))
    done = compact_table(table, options)
    return say({"groups": done.groups, "files_in": done.files_in, "files_out": done.files_out, "failed": list(done.failed)})


def main() -> int:
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(run(spark, sys.argv[1:]))
    except TableError as why:
        print(f"error: {why}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
