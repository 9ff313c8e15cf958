"""A table: scans that skip files, appends that make snapshots, and its inventory as DataFrames."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IncompatibleSchema, NotFound
from ..functions.transforms import PartitionField
from ..plans.expr import Predicate, as_predicate, may_match_bounds, may_match_partition, to_column
from ..sources.footer import DELETED, FILES, footer_tasks, introspect
from ..types import Schema, compatible, merge, new_fields
from .commit import Transaction
from .metadata import Metadata, Snapshot

REJECT, ADD_FIELDS = "reject", "add-fields"
#: Tasks that partition values are dealt to, for each file that a value asks for.
SLOTS = 16


@dataclass(frozen=True)
class Appended:
    """What an append did: kind is created, evolved or appended; no snapshot if there were no rows."""

    kind: str
    snapshot: Snapshot | None


class Table:
    def __init__(self, catalog, identifier: str, metadata: Metadata, metadata_path: str):
        self.catalog, self.identifier, self.metadata, self.metadata_path = catalog, identifier, metadata, metadata_path
        self.spark = catalog.spark

    @property
    def schema(self) -> Schema:
        return self.metadata.schema

    @property
    def spec(self) -> tuple[PartitionField, ...]:
        return self.metadata.spec

    def schema_at(self, snapshot_id: int | None) -> Schema:
        """The columns that the table had when the snapshot was made; today's without one."""
        return self.schema if snapshot_id is None else self.metadata.schema_of(self.metadata.snapshot(snapshot_id).schema_id)

    def refresh(self) -> Table:
        fresh = self.catalog.load_table(self.identifier)
        self.metadata, self.metadata_path = fresh.metadata, fresh.metadata_path
        return self

    def adopt(self, path: str) -> None:
        self.metadata, self.metadata_path = Metadata.parse(json.loads(self.catalog.storage.read(path))), path

    # --- inventory

    def manifest_list(self, snapshot: Snapshot) -> list[dict]:
        return json.loads(self.catalog.storage.read(snapshot.manifest_list))

    def files_with_stats(self, snapshot_id: int | None = None) -> DataFrame:
        """Live files of a snapshot (the current one by default) with counts and bounds; column ``manifest`` says where from."""
        snapshot = self.metadata.current if snapshot_id is None else self.metadata.snapshot(snapshot_id)
        if snapshot is None:
            raise NotFound(f"{self.identifier} has no snapshot")
        inventory = f"{FILES}, manifest string"
        paths = [m["manifest-path"] for m in self.manifest_list(snapshot)]
        if not paths:
            return self.spark.createDataFrame([], inventory)
        return self.spark.read.schema(inventory).parquet(*paths).where(F.col("status") != DELETED)

    def files(self, snapshot_id: int | None = None) -> DataFrame:
        return self.files_with_stats(snapshot_id).select("file_path", "file_format", "record_count", "file_size_in_bytes")

    def snapshots(self) -> DataFrame:
        refs: dict[int, list[str]] = {}
        for name, (sid, _) in sorted(self.metadata.refs.items()):
            refs.setdefault(sid, []).append(name)
        rows = [(s.snapshot_id, s.parent_id, s.sequence_number, s.timestamp_ms, s.summary.get("operation"), s.summary, refs.get(s.snapshot_id, []), s.snapshot_id == self.metadata.current_snapshot_id, s.manifest_list) for s in self.metadata.snapshots]
        return self.spark.createDataFrame(rows, "snapshot_id bigint, parent_id bigint, sequence_number bigint, timestamp_ms bigint, operation string, summary map<string,string>, refs array<string>, is_current boolean, manifest_list string")

    def totals(self) -> DataFrame:
        """Number of files, their bytes and their records."""
        files = self.files() if self.metadata.current else self.spark.createDataFrame([], FILES)
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
        return files.agg(F.count(F.lit(1)).alias("n_files"), total("file_size_in_bytes").alias("n_bytes"), total("record_count").alias("n_records"))

    # --- scans

    def _kept(self, p: Predicate, snapshot_id: int | None) -> DataFrame:
        files, schema = self.files_with_stats(snapshot_id), self.schema_at(snapshot_id)
        return files.withColumn("kept", may_match_partition(p, schema, self.spec) & may_match_bounds(p, schema))

    def plan(self, where: Predicate | str | None = None, snapshot_id: int | None = None) -> DataFrame:
        """One row: how many files a scan would read, of how many, and the percentage skipped."""
        rows = self._kept(as_predicate(where), snapshot_id).agg(F.coalesce(F.sum(F.col("kept").cast("bigint")), F.lit(0)).alias("kept"), F.count(F.lit(1)).alias("total"))
        return rows.withColumn("pruned_percent", F.when(F.col("total") > 0, (F.col("total") - F.col("kept")) / F.col("total") * 100).otherwise(0.0))

    def scan(self, where: Predicate | str | None = None, residual: bool = True, snapshot_id: int | None = None) -> DataFrame:
        """Rows that satisfy ``where`` (exactly; with ``residual=False`` all rows of the files that may hold some).

        Files are skipped by partition values and bounds before anything is
        read; only their paths come to the driver.  Columns that a file lacks
        are null.  An older snapshot has the columns of its time.  The result is
        an ordinary DataFrame: further filters and projections reach the Parquet
        scan.
        """
        p = as_predicate(where)
        schema = self.schema_at(snapshot_id)
        struct = by_name(schema)
        if self.metadata.current is None:
            return self.spark.createDataFrame([], struct)
        kept = self._kept(p, snapshot_id)
        paths = [r[0] for r in kept.where("kept").select("file_path").collect()]
        if not paths:
            rows = self.spark.createDataFrame([], struct)
        else:
            rows = self.spark.read.schema(struct).parquet(*paths).select(*(F.col(f"`{f.name}`") for f in struct.fields))
        return rows.where(to_column(p, schema)) if residual else rows

    # --- writes

    def transaction(self) -> Transaction:
        return Transaction(self)

    def evolve(self, incoming: Schema, policy: str = REJECT) -> bool:
        """Check incoming columns against the table's; with ``add-fields`` new ones are added. Whether any were."""
        if not compatible(self.schema, incoming):
            raise IncompatibleSchema("a column has another type in the table")
        if not new_fields(self.schema, incoming):
            return False
        if policy != ADD_FIELDS:
            raise IncompatibleSchema("new columns " + ", ".join(f.name for f in new_fields(self.schema, incoming)))
        self.catalog.update_schema(self, merge(self.schema, incoming))
        return True

    def write_files(self, df: DataFrame, files_per_partition: int | None = None, codec: str = "snappy") -> DataFrame:
        """Write rows as data files below the table and return their inventory rows; nothing refers to them yet.

        Rows are dealt by partition value; a value with many rows is split over
        several tasks.  ``files_per_partition`` asks for so many files a value
        instead, which suits values of a known size.
        """
        struct = self.schema.spark()
        missing = [f for f in struct.fields if f.name not in df.columns]
        rows = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) if f not in missing else F.lit(None).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in struct.fields))
        folders = self.folders()
        for f, folder in folders.items():
            rows = rows.withColumn(folder, f.transform.column(F.col(f"`{f.source}`"), self.schema.field(f.source).type))
        if files_per_partition:
            spread = F.pmod(F.monotonically_increasing_id(), F.lit(files_per_partition))
            if not folders:
                rows = rows.repartition(files_per_partition)
            elif files_per_partition == 1:
                rows = rows.repartition(*(F.col(f"`{c}`") for c in folders.values()))
            else:  # parts of a value go to tasks of their own
                slot = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in folders.values())), F.lit(SLOTS))
                rows = rows.repartitionById(SLOTS * files_per_partition, (slot * files_per_partition + spread).cast("int"))
        elif folders:
            rows = rows.hint("rebalance", *(F.col(f"`{c}`") for c in folders.values()))
        batch = f"{self.metadata.location}/data/{uuid.uuid4()}"
        writer = rows.write.option("compression", codec)
        (writer.partitionBy(*folders.values()) if folders else writer).parquet(batch)
        return self.inventory_of(batch)

    def inventory_of(self, folder: str) -> DataFrame:
        """Inventory rows of the files below a folder that was written with this table's partition folders."""
        from ..plans.persist import once

        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).select(plain_column("path").alias("file_path"))
        values = []
        for f, name in self.folders().items():
            raw = F.regexp_extract("file_path", f"/{re.escape(name)}=([^/]*)/", 1)
            # Folders are escaped by percent signs only: a plus sign is one.
            text = F.when(raw == "__HIVE_DEFAULT_PARTITION__", F.lit(None)).otherwise(F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))
            values += [F.lit(f.name), text]
        partition = F.create_map(*values) if values else F.create_map().cast("map<string,string>")
        # An empty text has the folder of null: such a value isn't known, so it is left out.
        texts = [f.name for f in self.spec if f.transform.result(self.schema.field(f.source).type) == "string"]
        if texts:
            partition = F.map_filter(partition, lambda k, v: v.isNotNull() | ~k.isin(texts))
        paths = found.withColumn("partition", partition).repartition(footer_tasks(found.count()))
        return once(introspect(paths, self.schema).where("record_count > 0"))

    def folders(self) -> dict[PartitionField, str]:
        """The folder name of each partition field: its own, unless a column has it."""
        names = {f.name for f in self.schema.fields}
        return {f: f.name if f.name not in names else f"{f.name}_part" for f in self.spec}

    def append(self, df: DataFrame, policy: str = REJECT, files_per_partition: int | None = None, timestamp_ms: int | None = None) -> Appended:
        """Add rows as one snapshot, whatever number of files and partitions they take."""
        evolved = self.evolve(Schema.of(df.schema), policy)
        files = self.write_files(df, files_per_partition)
        first = self.metadata.current is None
        snapshot = self.transaction().append(files).commit(timestamp_ms) if files.limit(1).count() else None
        return Appended("created" if first else "evolved" if evolved else "appended", snapshot)


def by_name(schema: Schema) -> T.StructType:
    """The schema to read files with: files are resolved by name, as registered ones needn't carry ids."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.spark().fields])


def plain_column(c: str):
    """A local path without its scheme."""
    return F.regexp_replace(c, "^file:/*", "/")


def append_or_create(catalog, identifier: str, df: DataFrame, spec=(), policy: str = REJECT, **options) -> tuple[Table, Appended]:
    """Append to a table, making it (and its namespace) first if it isn't there."""
    from .catalog import parse_identifier

    namespace, _ = parse_identifier(identifier)
    catalog.create_namespace(".".join(namespace), exist_ok=True)
    if catalog.table_exists(identifier):
        table = catalog.load_table(identifier)
        return table, table.append(df, policy, **options)
    table = catalog.create_table(identifier, Schema.of(df.schema), spec)
    done = table.append(df, policy, **options)
    return table, Appended("created", done.snapshot)
