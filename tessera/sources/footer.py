"""Parquet footers as rows of the file inventory, read by the executors."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from decimal import Decimal
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidFile, InvalidPartition
from ..types import Schema

#: The file inventory: a row per file with all that planning needs.
FILES = (
    "file_path string, file_format string, content int, status int, snapshot_id bigint, sequence_number bigint, spec_id int, "
    "record_count bigint, file_size_in_bytes bigint, partition map<string,string>, column_sizes map<int,bigint>, value_counts map<int,bigint>, "
    "null_value_counts map<int,bigint>, lower_bounds map<int,string>, upper_bounds map<int,string>, split_offsets array<bigint>"
)
EXISTING, ADDED, DELETED = 0, 1, 2


def is_local_path(path: str) -> bool:
    return "://" not in path and not path.startswith("file:")


def hive_values(path: str) -> dict[str, str]:
    """``key=value`` folders of a path, escapes undone; the file's own name doesn't count."""
    pairs = (part.split("=", 1) for part in path.split("/")[:-1] if "=" in part)
    return {k: unquote(v) for k, v in pairs if k}


def typed_values(found: dict[str, str], types: dict[str, str]) -> dict[str, object]:
    """Values of the named types; anything unknown stays text.  Values that don't fit are an error."""
    out: dict[str, object] = {}
    for k, v in found.items():
        kind = types.get(k, "string")
        try:
            if kind in ("int", "long", "year", "month", "hour"):
                out[k] = int(v)
            elif kind == "boolean":
                out[k] = {"true": True, "false": False}[v.lower()]
            elif kind in ("date", "day"):
                out[k] = dt.date.fromisoformat(v) if "-" in v[1:] else dt.date(1970, 1, 1) + dt.timedelta(days=int(v))
            else:
                out[k] = v
        except (ValueError, KeyError):
            raise InvalidPartition(f"expected {kind} for {k}, found {v!r}") from None
    return out


def values_by_spec(path: str, types: dict[str, str], explicit: dict[str, str] | None = None) -> dict[str, str]:
    """Texts of all partition fields of a path, given ones before those of its folders; a missing or unfit one is an error."""
    found = hive_values(path) | (explicit or {})
    for k in types:
        if k not in found:
            raise InvalidPartition(f"missing partition segment {k!r} in {path}")
    typed_values({k: found[k] for k in types}, types)
    return {k: found[k] for k in types}


# Schemes of Hadoop's file systems by the names that Arrow's have.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "wasb": "abfs", "wasbs": "abfss"}


def open_store(path: str):
    """(file system, path in it) for reading a few bytes of a file on an executor, where Hadoop's file systems aren't at hand."""
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        path = plain(path)
    if is_local_path(path):
        return pafs.LocalFileSystem(), path
    scheme, _, rest = path.partition("://")
    return pafs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}://{rest}")


def partition_key(values: dict[str, object]) -> str:
    """``k=v`` in order of the names, joined by slashes."""
    return "/".join(f"{k}={values[k]}" for k in sorted(values))


def partition_key_column(path):
    """Column form: the ``k=v`` folders of a path as they stand."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.array_join(F.filter(folders, lambda x: x.contains("=")), "/")


def bound_text(value: object) -> str | None:
    """A bound as text that casts back to its column's type."""
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            return value.astimezone(dt.timezone.utc).replace(tzinfo=None).isoformat(" ") + "Z"
        return value.isoformat(" ")
    if isinstance(value, (dt.date, int, str)):
        return value.isoformat() if isinstance(value, dt.date) else str(value)
    if isinstance(value, bytes):
        return value.hex()
    if isinstance(value, float):
        return None if value != value else repr(value)
    return str(value) if isinstance(value, Decimal) else None


def read_footer(path: str, ids: dict[str, int] | None) -> dict:
    """One file's counts, sizes and bounds by field id, over all of its row groups."""
    import pyarrow.parquet as pq

    try:
        files, at = open_store(path)
        size = files.get_file_info(at).size
        with files.open_input_file(at) as handle:
            meta = pq.read_metadata(handle)
    except Exception as why:
        raise InvalidFile(f"{path}: {why}") from None
    sizes: dict[int, int] = {}
    values: dict[int, int] = {}
    nulls: dict[int, int] = {}
    low: dict[int, object] = {}
    high: dict[int, object] = {}
    unknown: set[int] = set()
    schema = meta.schema.to_arrow_schema()
    own = {f.name: int(f.metadata[b"PARQUET:field_id"]) for f in schema if f.metadata and b"PARQUET:field_id" in f.metadata}
    known = ids if ids is not None else {f.name: own.get(f.name, i + 1) for i, f in enumerate(schema)}
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            column = group.column(c)
            top = column.path_in_schema.split(".")[0]
            if top not in known:
                continue
            i = known[top]
            sizes[i] = sizes.get(i, 0) + column.total_uncompressed_size
            if column.path_in_schema != top:
                unknown.add(i)  # nested: sizes only
                continue
            stats = column.statistics
            if stats is None or not stats.has_null_count:
                unknown.add(i)
                continue
            nulls[i] = nulls.get(i, 0) + stats.null_count
            values[i] = values.get(i, 0) + stats.num_values
            if stats.has_min_max:
                a, b = stats.min, stats.max
                low[i] = a if i not in low else min(low[i], a)
                high[i] = b if i not in high else max(high[i], b)
            elif stats.num_values:
                low[i] = high[i] = None
                unknown.add(-i)
    text = lambda bounds: {i: t for i, v in bounds.items() if i not in unknown and -i not in unknown and (t := bound_text(v)) is not None}
    offsets = [min(x for x in (meta.row_group(g).column(0).dictionary_page_offset, meta.row_group(g).column(0).data_page_offset) if x) for g in range(meta.num_row_groups) if meta.num_columns]
    counted = lambda d: {i: n for i, n in d.items() if i not in unknown}
    return {
        "file_path": path, "file_format": "parquet", "content": 0, "status": ADDED, "snapshot_id": None, "sequence_number": None, "spec_id": 0,
        "record_count": meta.num_rows, "file_size_in_bytes": size, "partition": {}, "column_sizes": sizes, "value_counts": counted(values), "null_value_counts": counted(nulls),
        "lower_bounds": text(low), "upper_bounds": text(high), "split_offsets": offsets, "columns": "; ".join(f"{f.name} {f.type}" for f in schema),
    }


def footer_tasks(files: int) -> int:
    """Tasks to read so many footers: some dozens each, but all cores at work when there are many."""
    return max(1, min(2000, files // 32 + 1))


def introspect(paths: DataFrame, schema: Schema | None = None, columns: bool = False) -> DataFrame:
    """Inventory rows of Parquet files (one column of paths, optionally ``partition``); only footers are read.

    Without a table schema, files' own field ids count, or else places.  With
    ``columns`` a file's columns and their types come along as text.
    """
    ids = None if schema is None else {f.name: f.id for f in schema.fields}
    has_partition = "partition" in paths.columns
    out = T._parse_datatype_string(FILES + (", columns string" if columns else ""))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [read_footer(p, ids) for p in frame["file_path"]]
            if has_partition:
                for row, values in zip(rows, frame["partition"], strict=True):
                    row["partition"] = dict(values or {})
            yield pd.DataFrame(rows, columns=out.fieldNames())

    return paths.mapInPandas(run, out)


def footer_schema(spark: SparkSession, path: str) -> T.StructType:
    """The Spark schema of a Parquet file, with the field ids it carries."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    struct = spark.read.parquet(path).schema
    files, at = open_store(path)
    info = files.get_file_info(at)
    if info.type != pafs.FileType.File:
        return struct
    with files.open_input_file(at) as handle:
        arrow = pq.read_schema(handle)
    ids = {f.name: int(f.metadata[b"PARQUET:field_id"]) for f in arrow if f.metadata and b"PARQUET:field_id" in f.metadata}
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, **({"parquet.field.id": ids[f.name]} if f.name in ids else {})}) for f in struct.fields])


def expand(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """(file_path, file_size) of the Parquet files that a path, a glob or a list of these names; none is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(pattern).select(F.col("path").alias("file_path"), F.col("length").alias("file_size"))
    if not found.limit(1).count():
        raise InvalidFile(f"no Parquet files match {pattern}")
    return found


def plain(path: str) -> str:
    """A local path without its scheme; others as they are."""
    return re.sub(r"^file:/*", "/", path)
