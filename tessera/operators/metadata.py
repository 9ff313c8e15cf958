"""A table's state as one JSON document: schemas, partition spec, snapshots and references."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..errors import InvalidMetadata
from ..functions.transforms import PartitionField, Transform
from ..types import Schema, max_id


@dataclass(frozen=True)
class Snapshot:
    snapshot_id: int
    parent_id: int | None
    sequence_number: int
    timestamp_ms: int
    manifest_list: str
    summary: dict[str, str]
    schema_id: int

    def json(self) -> dict:
        return {"snapshot-id": self.snapshot_id, "sequence-number": self.sequence_number, "timestamp-ms": self.timestamp_ms, "manifest-list": self.manifest_list, "summary": self.summary, "schema-id": self.schema_id} | ({} if self.parent_id is None else {"parent-snapshot-id": self.parent_id})

    @staticmethod
    def parse(d: dict) -> Snapshot:
        return Snapshot(d["snapshot-id"], d.get("parent-snapshot-id"), d.get("sequence-number", 0), d["timestamp-ms"], d["manifest-list"], d.get("summary", {}), d.get("schema-id", 1))


@dataclass(frozen=True)
class Metadata:
    table_id: str
    location: str
    updated_ms: int
    last_column_id: int
    current_schema_id: int
    schemas: tuple[Schema, ...]
    spec: tuple[PartitionField, ...] = ()
    properties: dict[str, str] = field(default_factory=dict)
    current_snapshot_id: int | None = None
    snapshots: tuple[Snapshot, ...] = ()
    snapshot_log: tuple[tuple[int, int], ...] = ()
    #: name -> (snapshot id, "branch" or "tag")
    refs: dict[str, tuple[int, str]] = field(default_factory=dict)
    last_sequence_number: int = 0
    format_version: int = 2

    @property
    def schema(self) -> Schema:
        return self.schema_of(self.current_schema_id)

    def schema_of(self, schema_id: int) -> Schema:
        for s in self.schemas:
            if s.schema_id == schema_id:
                return s
        raise InvalidMetadata(f"no schema {schema_id}")

    @property
    def current(self) -> Snapshot | None:
        return None if self.current_snapshot_id is None else self.snapshot(self.current_snapshot_id)

    def snapshot(self, snapshot_id: int) -> Snapshot:
        for s in self.snapshots:
            if s.snapshot_id == snapshot_id:
                return s
        raise InvalidMetadata(f"no snapshot {snapshot_id}")

    def with_snapshot(self, s: Snapshot) -> Metadata:
        """Add a snapshot, make it current and move the main branch."""
        return replace(
            self, snapshots=(*self.snapshots, s), current_snapshot_id=s.snapshot_id, snapshot_log=(*self.snapshot_log, (s.timestamp_ms, s.snapshot_id)),
            refs={**self.refs, "main": (s.snapshot_id, "branch")}, updated_ms=s.timestamp_ms, last_sequence_number=max(self.last_sequence_number, s.sequence_number),
        )

    def with_schema(self, schema: Schema) -> Metadata:
        others = tuple(s for s in self.schemas if s.schema_id != schema.schema_id)
        return replace(self, schemas=(*others, schema), current_schema_id=schema.schema_id, last_column_id=max(self.last_column_id, max_id(schema.fields)))

    def with_ref(self, name: str, snapshot_id: int, kind: str = "tag") -> Metadata:
        self.snapshot(snapshot_id)
        return replace(self, refs={**self.refs, name: (snapshot_id, kind)})

    def without_snapshots(self, ids: list[int]) -> Metadata:
        gone = set(ids)
        if self.current_snapshot_id in gone or any(s in gone for s, _ in self.refs.values()):
            raise InvalidMetadata("a snapshot that is current or referenced can't expire")
        return replace(self, snapshots=tuple(s for s in self.snapshots if s.snapshot_id not in gone), snapshot_log=tuple(x for x in self.snapshot_log if x[1] not in gone))

    def json(self) -> dict:
        return {
            "format-version": self.format_version, "table-uuid": self.table_id, "location": self.location, "last-updated-ms": self.updated_ms, "last-column-id": self.last_column_id,
            "last-sequence-number": self.last_sequence_number, "current-schema-id": self.current_schema_id, "schemas": [s.json() for s in self.schemas],
            "partition-spec": [f.json() for f in self.spec], "properties": self.properties, "current-snapshot-id": self.current_snapshot_id, "snapshots": [s.json() for s in self.snapshots],
            "snapshot-log": [{"timestamp-ms": t, "snapshot-id": s} for t, s in self.snapshot_log], "refs": {n: {"snapshot-id": s, "type": k} for n, (s, k) in self.refs.items()},
        }

    @staticmethod
    def parse(d: dict) -> Metadata:
        current = d.get("current-snapshot-id")
        return Metadata(
            d["table-uuid"], d["location"], d["last-updated-ms"], d["last-column-id"], d["current-schema-id"], tuple(map(Schema.parse, d["schemas"])),
            tuple(PartitionField(f["source"], Transform.parse(f["transform"]), f["name"], f["field-id"]) for f in d.get("partition-spec", [])), d.get("properties", {}),
            None if current in (None, -1) else current, tuple(map(Snapshot.parse, d.get("snapshots", []))), tuple((x["timestamp-ms"], x["snapshot-id"]) for x in d.get("snapshot-log", [])),
            {n: (r["snapshot-id"], r["type"]) for n, r in d.get("refs", {}).items()}, d.get("last-sequence-number", 0), d.get("format-version", 2),
        )
