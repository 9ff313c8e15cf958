"""Adding existing Parquet files to a table without rewriting them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IncompatibleSchema, InvalidInput, InvalidPartition, NotFound, NothingRegistered, from_worker
from ..functions.transforms import PartitionField, Transform, parse_spec
from ..plans.persist import once
from ..sources.footer import FILES, expand, footer_schema, footer_tasks, introspect, is_local_path, partition_key, values_by_spec
from ..types import Schema, compatible, merge, new_fields, same_type
from .metadata import Snapshot
from .table import ADD_FIELDS, REJECT, Table, plain_column


@dataclass(frozen=True)
class RegisterOptions:
    fail_if_missing: bool = True
    policy: str = REJECT
    allow_noop: bool = False


@dataclass(frozen=True)
class Registered:
    added_files: int
    added_records: int
    skipped: int
    snapshot: Snapshot | None
    created: bool = False


def check_absolute(path: str) -> str:
    if not (path.startswith("/") or not is_local_path(path)):
        raise InvalidInput(f"not an absolute path: {path}")
    return path


def check_files_match(a: Schema, b: Schema) -> None:
    """Same columns in the same order with the same types; whether values may be missing doesn't matter."""
    if [f.name for f in a.fields] != [f.name for f in b.fields]:
        raise IncompatibleSchema("columns differ")
    for f, g in zip(a.fields, b.fields, strict=True):
        if not same_type(f.type, g.type):
            raise IncompatibleSchema(f"{f.name} is {f.type} and {g.type}")


def parse_values(text: str) -> dict[str, str]:
    """``a=1,b=2``"""
    pairs = [p.split("=", 1) for p in text.split(",") if p.strip()]
    if any(len(p) != 2 for p in pairs):
        raise InvalidInput(f"expected name=value, found {text!r}")
    return {k.strip(): v.strip() for k, v in pairs}


def parse_identity_spec(text: str, schema: Schema) -> tuple[PartitionField, ...]:
    """``year:int,month:int``: identity fields whose columns must be in the files with these types."""
    fields = []
    for i, part in enumerate(p for p in text.split(",") if p.strip()):
        name, _, kind = (x.strip() for x in part.partition(":"))
        column = schema.field(name)
        if column is None or column.type != (kind or column.type):
            raise InvalidInput(f"no column {name} of type {kind}")
        fields.append(PartitionField(name, Transform("identity"), name, 1000 + i))
    return tuple(fields)


def value_types(schema: Schema, spec: tuple[PartitionField, ...]) -> dict[str, str]:
    """What the partition values in paths must be."""
    return {f.name: f.transform.kind if f.transform.kind in ("year", "month", "day", "hour") else _plain_type(schema, f) for f in spec}


def _plain_type(schema: Schema, field: PartitionField) -> str:
    if field.transform.kind == "bucket":
        return "int"
    source = schema.field(field.source)
    return source.type if source and source.type in ("int", "long", "boolean", "date") else "string"


#: Different schemas that one registration may meet; each is looked at on the driver.
SCHEMAS = 1000


def register(catalog, identifier: str, pattern: str | list[str], options: RegisterOptions = RegisterOptions(), spec=(), explicit: dict[str, str] | None = None, timestamp_ms: int | None = None) -> Registered:
    """Register the Parquet files that a path or glob names; files that are in the table already are skipped.

    The first file's columns make the table if it isn't there and may be made.
    Every file must have the table's columns, or with the policy of adding
    fields columns of the same types; if one hasn't, nothing is registered or
    made.  Only footers are read.  With nothing new it is an error, or with
    ``allow_noop`` a result of zeros.
    """
    spark = catalog.spark
    for one in [pattern] if isinstance(pattern, str) else pattern:
        check_absolute(one)
    paths = once(expand(spark, pattern).select(plain_column("file_path").alias("file_path")).distinct())
    table = catalog.load_table(identifier) if catalog.table_exists(identifier) else None
    if table is None and options.fail_if_missing:
        raise NotFound(identifier)
    known = table.files().select("file_path") if table is not None and table.metadata.current else paths.limit(0)
    fresh = once(paths.join(known, "file_path", "left_anti"))
    total, n_fresh = paths.count(), fresh.count()
    sample = (fresh if n_fresh else paths).orderBy("file_path").first()[0]
    first = Schema.of(footer_schema(spark, sample))
    schema = first if table is None else merge(table.schema, first) if options.policy == ADD_FIELDS and new_fields(table.schema, first) else table.schema
    if table is not None:
        fields = table.spec
    else:
        fields = parse_identity_spec(spec, first) if isinstance(spec, str) and ":" in spec else parse_spec(spec) if isinstance(spec, str) else tuple(spec)
    wanted = _with_values(value_types(schema, fields), fresh, explicit).repartition(footer_tasks(n_fresh))
    try:
        files = once(introspect(wanted, schema, columns=True))
    except Exception as why:
        raise from_worker(why) from why
    kinds = files.groupBy("columns").agg(F.min("file_path").alias("path")).limit(SCHEMAS + 1).collect()
    if len(kinds) > SCHEMAS:
        raise IncompatibleSchema(f"files of more than {SCHEMAS} different schemas")
    merged = schema
    for own in [first] if not kinds else [Schema.of(footer_schema(spark, r["path"])) for r in sorted(kinds, key=lambda r: r["path"])]:
        if options.policy != ADD_FIELDS:
            check_files_match(schema, own)
        elif not compatible(merged, own):
            raise IncompatibleSchema("a column has another type in the table")
        elif new_fields(merged, own):
            merged = merge(merged, own)
    if new_fields(schema, merged):  # a later file brought columns of its own: their counts need the ids that they have now
        files = once(introspect(wanted, merged, columns=True))
    created = table is None
    if created:
        from .catalog import parse_identifier

        catalog.create_namespace(".".join(parse_identifier(identifier)[0]), exist_ok=True)
        table = catalog.create_table(identifier, replace(merged, schema_id=1), fields)
    elif new_fields(table.schema, merged):
        table.evolve(merged, ADD_FIELDS)
    if not n_fresh:
        if not options.allow_noop:
            raise NothingRegistered(f"all {total} files are in {identifier} already")
        return Registered(0, 0, total, None, created)
    snapshot = table.transaction().append(files.drop("columns")).commit(timestamp_ms)
    return Registered(n_fresh, int(snapshot.summary["added-records"]), total - n_fresh, snapshot, created)


def _with_values(types: dict[str, str], paths: DataFrame, explicit: dict[str, str] | None) -> DataFrame:
    """Paths with their partition values, checked where they are made."""
    if not types:
        return paths.withColumn("partition", F.create_map().cast("map<string,string>"))

    def run(frames):
        for frame in frames:
            yield frame.assign(partition=[values_by_spec(p, types, explicit) for p in frame["file_path"]])

    return paths.mapInPandas(run, "file_path string, partition map<string,string>")


def register_known(table: Table, files: DataFrame, timestamp_ms: int | None = None) -> Registered:
    """Register files of which all is known, without reading them.

    ``files``: file_path, record_count, file_size_in_bytes and any further
    columns of the inventory (counts and bounds by field id, partition values);
    what is missing isn't known.  Every partition field must have a value.
    Files that are in the table already are skipped.
    """
    given = set(files.columns)
    if lacking := {"file_path", "record_count", "file_size_in_bytes"} - given:
        raise InvalidInput("files need " + ", ".join(sorted(lacking)))
    rest = {"file_format": F.lit("parquet"), "content": F.lit(0), "spec_id": F.lit(0)}
    struct = T._parse_datatype_string(FILES)
    columns = [F.col(f.name) if f.name in given else rest.get(f.name, F.create_map() if isinstance(f.dataType, T.MapType) else F.lit(None)) for f in struct.fields]
    rows = once(files.select(*(c.cast(f.dataType).alias(f.name) for c, f in zip(columns, struct.fields, strict=True))).dropDuplicates(["file_path"]))
    names = F.array(*(F.lit(f.name) for f in table.spec)) if table.spec else F.array().cast("array<string>")
    if rows.where(F.size(F.array_except(names, F.coalesce(F.map_keys("partition"), F.array().cast("array<string>")))) > 0).limit(1).count():
        raise InvalidPartition("a file lacks a partition value")
    fresh = once(rows.join(table.files().select("file_path"), "file_path", "left_anti")) if table.metadata.current else rows
    total, n_fresh = rows.count(), fresh.count()
    if not n_fresh:
        raise NothingRegistered(f"all {total} files are in {table.identifier} already")
    snapshot = table.transaction().append(fresh).commit(timestamp_ms)
    return Registered(n_fresh, int(snapshot.summary["added-records"]), total - n_fresh, snapshot)


def partition_summary(files: DataFrame) -> DataFrame:
    """Files and records of each partition key of the inventory."""
    entries = F.array_sort(F.transform(F.map_entries("partition"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))))
    return files.groupBy(F.array_join(entries, "/").alias("partition_key")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("record_count").alias("n_records"))


def upload(table: Table, path: str) -> str:
    """Copy a local file to the table's data folder under a name of its own."""
    stem = path.rsplit("/", 1)[-1].removesuffix(".parquet")
    at = f"{table.metadata.location}/data/{stem}_{uuid.uuid4()}.parquet"
    table.catalog.storage.copy(path, at)
    return at


__all__ = ["RegisterOptions", "Registered", "partition_key", "partition_summary", "register", "register_known", "upload"]
