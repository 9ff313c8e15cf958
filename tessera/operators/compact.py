"""Compaction: small files of a partition become larger ones."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..errors import CompactionFailed, InvalidInput
from ..plans.persist import once
from ..sources.footer import footer_tasks, introspect, partition_key_column
from .table import Table, by_name, plain_column

MIB = 1 << 20


@dataclass(frozen=True)
class CompactOptions:
    """Fixed defaults: 256 MiB targets, inputs below 128 MiB, three files at least, 512 MiB a group."""

    target_bytes: int = 256 * MIB
    max_input_bytes: int = 128 * MIB
    min_files: int = 3
    max_group_bytes: int = 512 * MIB
    partition: str | None = None
    dry_run: bool = False
    allow_partial: bool = False

    def __post_init__(self) -> None:
        for ok, why in (
            (self.target_bytes >= 1024, "the target must be 1 KiB at least"),
            (self.target_bytes > self.max_input_bytes, "the target must be above the largest input"),
            (self.min_files >= 2, "a group needs two files at least"),
            (self.max_group_bytes >= self.target_bytes, "a group must be able to reach the target"),
        ):
            if not ok:
                raise InvalidInput(why)


#: Files whose packing a task sums up at a time.
FILES_A_TASK = 100_000
NEVER = (1 << 63) - 1
OUTCOMES = pa.schema([("partition_key", pa.string()), ("part", pa.int32()), ("run", pa.int32()), *((name, pa.int64()) for name in ("through", "files", "groups", "used", "members"))])
ENTRIES = pa.schema([("part", pa.int32()), ("before", pa.int32()), *((name, pa.int64()) for name in ("group_id", "used", "members", "total"))])


def first_fit(sizes: list[int], capacity: int, group: int = 0, used: int = 0) -> list[int]:
    """The bin of each of ascending sizes: the first with room, which only the newest can have (at first ``group``, of which ``used`` is taken)."""
    out, room = [], capacity - used
    for size in sizes:
        if size > room:
            group, room = group + 1, capacity
        out.append(group)
        room -= size
    return out


def outcomes(sizes: np.ndarray, capacity: int, debt: int = 0) -> dict[str, np.ndarray]:
    """What a run of ascending sizes makes of any group that is open before it.

    A row for each file that may be the first without room in that group, which
    is so if ``through``, the bytes up to this file, don't fit; ``files`` are
    before it, ``groups`` begin from it on, and the last of these has ``used``
    bytes and ``members`` when the run ends.  The last row is for all fitting.
    ``debt``: how far a group's bytes can be below nothing.
    """
    n = len(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    low = int(np.searchsorted(sizes, 0, "right"))  # these fit anywhere
    after = (np.searchsorted(ends[low + 1 :], ends[:-1] + capacity, "right") + low).tolist()  # the first file not in the group that each would open
    groups, last = [1] * n, list(range(n))
    for i in range(n - 1, low - 1, -1):
        if after[i] < n:
            groups[i], last[i] = groups[after[i]] + 1, last[after[i]]
    many = low + int(np.searchsorted(ends[low:-1], capacity + debt, "right"))
    begin = np.array(last[low:many], dtype=np.int64)
    with_all = lambda values, rest: np.append(np.asarray(values, dtype=np.int64), rest)
    return {
        "through": with_all(ends[low + 1 : many + 1], NEVER), "files": with_all(range(low, many), n), "groups": with_all(groups[low:many], 0),
        "used": with_all(ends[n] - ends[begin], ends[n]), "members": with_all(n - begin, n),
    }


def runs_of_keys(batch: pa.RecordBatch) -> list[tuple[str, pa.RecordBatch]]:
    """Slices of consecutive rows of one partition."""
    keys = batch.column("partition_key")
    at = [0, *(np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(keys)]
    return [(keys[a].as_py(), batch.slice(a, b - a)) for a, b in zip(at, at[1:], strict=False) if b > a]


def sums(batches: Iterable[pa.RecordBatch], capacity: int, debt: int, most: int) -> Iterator[pa.RecordBatch]:
    """Outcomes of a task's sorted files, ``most`` at a time, for its first and last partition: only these can reach beyond the task."""
    key, part, first, run, sizes, made = None, None, True, 0, [], []

    def flush():
        nonlocal run, sizes, made
        if sizes:
            rows = outcomes(np.concatenate(sizes), capacity, debt)
            n = len(rows["through"])
            made.append(pa.RecordBatch.from_pydict({"partition_key": [key] * n, "part": [part] * n, "run": [run] * n} | rows, schema=OUTCOMES))
            run, sizes = run + 1, []

    for batch in batches:
        for k, rows in runs_of_keys(batch):
            if k != key:
                if first and key is not None:
                    flush()
                    yield from made
                    first = False
                key, part, run, sizes, made = k, rows.column("part")[0].as_py(), 0, [], []
            found = rows.column("file_size_in_bytes").to_numpy(zero_copy_only=False)
            while len(found):
                free = most - sum(map(len, sizes))
                sizes.append(found[:free])
                found = found[free:]
                if len(sizes[-1]) == free:
                    flush()
            if first:
                yield from made
                made = []
    flush()
    yield from made


def entries(batches: Iterable[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """For each part in which a partition goes on: the group that is open when it begins, and how many members that gets in all.

    ``batches``: outcomes in order.  Of each run the first row whose bytes don't
    fit is what happens.
    """
    key, part, done, group, used, members = None, None, None, 0, 0, 0
    waiting, out = [], []

    def close(total: int) -> None:
        out.extend((*w, total) for w in waiting)
        waiting.clear()

    for batch in batches:
        for k, p, run, through, files, groups, bytes_, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                close(members)
                key, part, done, group, used, members = k, p, None, 0, 0, 0
            elif p != part:
                waiting.append((p, part, group, used, members))
                part = p
            if done == (p, run) or through <= capacity - used:
                continue
            done = (p, run)
            if groups:
                close(members + files)
                group, used, members = group + groups, bytes_, n
            else:
                used, members = used + bytes_, members + n
    close(members)
    yield pa.RecordBatch.from_pydict({f.name: [row[i] for row in out] for i, f in enumerate(ENTRIES)}, schema=ENTRIES)


def packed(batches: Iterable[pa.RecordBatch], capacity: int, least: int, heads: dict[int, tuple], tails: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """A task's sorted files with their groups, without groups of fewer than ``least``.

    ``heads``: of a part, the group that is open when it begins, its bytes, its
    members so far and in all; ``tails``: the members in all of the group that is
    open when the part ends.
    """
    key, part, group, used, members, known, held = None, None, 0, 0, 0, 0, []
    for batch in batches:
        for k, rows in runs_of_keys(batch):
            if part is None:
                key, part = k, rows.column("part")[0].as_py()
                group, used, members, known = heads.get(part, (0, 0, 0, 0))
            elif k != key:
                key, group, used, members, known, held = k, 0, 0, 0, 0, []
            sizes = rows.column("file_size_in_bytes").to_numpy(zero_copy_only=False)
            found = np.array(first_fit(sizes.tolist(), capacity, group, used), dtype=np.int64)
            rows = pa.RecordBatch.from_arrays([rows.column("partition_key"), pa.array(found), rows.column("file_path"), rows.column("file_size_in_bytes")], ["partition_key", "group_id", "file_path", "file_size_in_bytes"])
            counts = np.bincount(found - group)
            counts[0] = max(counts[0] + members, known)
            if counts[0] >= least:
                yield from held
            if counts[0] >= least or len(counts) > 1:
                held = []
            yield rows.filter(pa.array(counts[found - group] >= least))
            begin = int(np.searchsorted(found, found[-1]))  # of the newest group
            if counts[-1] < least:
                held.append(rows.slice(begin))
            if len(counts) > 1:
                group, used, members, known = int(found[-1]), 0, 0, 0
            used, members = used + int(sizes[begin:].sum()), members + len(sizes) - begin
    if tails.get(part, 0) >= least:
        yield from held


def plan_compaction(files: DataFrame, options: CompactOptions = CompactOptions()) -> DataFrame:
    """(partition_key, group_id, file_path, file_size_in_bytes) of the files to be compacted together.

    ``files``: file_path and file_size_in_bytes.  Files below the largest input
    size go, smallest first, to the first group of their partition with room;
    groups of fewer than ``min_files`` are left alone.  Files are sorted over
    all tasks; each task says what its own do to any group that may be open
    before them, from which follows where each begins.
    """
    capacity, least, most = min(options.target_bytes, options.max_group_bytes), options.min_files, FILES_A_TASK
    small = files.select("file_path", "file_size_in_bytes", partition_key_column(F.col("file_path")).alias("partition_key")).where((F.col("file_size_in_bytes") < options.max_input_bytes) & F.col("file_path").isNotNull())
    if options.partition is not None:
        small = small.where(F.col("partition_key") == options.partition)
    order = ("partition_key", "file_size_in_bytes", "file_path")
    dealt = once(small.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    debt = -(dealt.agg(F.sum(F.least("file_size_in_bytes", F.lit(0)))).first()[0] or 0)
    made = dealt.select("partition_key", "file_size_in_bytes", "part").mapInArrow(lambda batches: sums(batches, capacity, debt, most), from_arrow_schema(OUTCOMES))
    found = made.repartition("partition_key").sortWithinPartitions("partition_key", "part", "run", "through").mapInArrow(lambda batches: entries(batches, capacity), from_arrow_schema(ENTRIES)).collect()
    heads, tails = {r["part"]: tuple(r)[2:] for r in found}, {r["before"]: r["total"] for r in found}  # a row a task at most
    return dealt.mapInArrow(lambda batches: packed(batches, capacity, least, heads, tails), "partition_key string, group_id bigint, file_path string, file_size_in_bytes bigint")


def plan_totals(plan: DataFrame, options: CompactOptions = CompactOptions()) -> DataFrame:
    """One row: groups, files and bytes in, and files that would come out."""
    groups = plan.groupBy("partition_key", "group_id").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size_in_bytes").alias("bytes"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return groups.agg(F.count(F.lit(1)).alias("n_groups"), total("files").alias("n_files"), total("bytes").alias("n_bytes"), total(F.greatest(F.lit(1), F.ceil(F.col("bytes") / options.target_bytes))).alias("n_output_files"))


@dataclass(frozen=True)
class Compacted:
    groups: int
    files_in: int
    files_out: int
    failed: tuple[str, ...] = ()


def compact_table(table: Table, options: CompactOptions = CompactOptions(), timestamp_ms: int | None = None) -> Compacted:
    """Rewrite small files; each group becomes one file with the table's columns.

    One job writes all groups, a task each, and one snapshot replaces their
    files.  If that fails and partial results are allowed, partitions are tried
    one by one.
    """
    if table.metadata.current is None:
        return Compacted(0, 0, 0)
    live = table.files_with_stats()
    plan = once(plan_compaction(live, options))
    groups = plan.select("partition_key", "group_id").distinct().count()
    n_in = plan.count()
    if not groups or options.dry_run:
        return Compacted(groups, n_in, groups)
    try:
        _replace(table, plan, timestamp_ms)
        return Compacted(groups, n_in, groups)
    except Exception as why:
        if not options.allow_partial:
            raise CompactionFailed(str(why)) from why
    failed, done_groups, done_files = [], 0, 0
    for key, n in plan.groupBy("partition_key").agg(F.countDistinct("group_id")).orderBy("partition_key").collect():
        members = plan.where(F.col("partition_key") == key)
        try:
            _replace(table, members, timestamp_ms)
            done_groups, done_files = done_groups + n, done_files + members.count()
        except Exception:
            failed.append(key)
    return Compacted(done_groups, done_files, done_groups, tuple(failed))


def _replace(table: Table, plan: DataFrame, timestamp_ms: int | None) -> None:
    table.refresh()
    table.transaction().rewrite(plan, _rewrite(table, plan)).commit(timestamp_ms)


def _rewrite(table: Table, plan: DataFrame) -> DataFrame:
    """Inventory rows of new files, one for each group of ``plan``."""
    spark, storage, location = table.spark, table.catalog.storage, table.metadata.location
    order = Window.orderBy("partition_key", "group_id")  # a row a group
    facts = plan.join(table.files_with_stats().select("file_path", "partition", "record_count"), "file_path").groupBy("partition_key", "group_id")
    facts = facts.agg(F.count(F.lit(1)).alias("files"), F.sum("record_count").alias("records"), F.min_by("partition", "file_path").alias("partition"))
    groups = once(facts.withColumn("number", (F.row_number().over(order) - 1).cast("int")))
    number_of = once(plan.join(groups, ["partition_key", "group_id"]).select("file_path", "number"))
    struct = table.schema.spark()
    rows = spark.read.schema(by_name(table.schema)).parquet(*(r[0] for r in number_of.select("file_path").collect()))
    at = plain_column(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    names = {f.name: f"c{i}" for i, f in enumerate(struct.fields)}  # whatever the columns are called
    rows = rows.select(at.alias("file_path"), *(F.col(f"`{f.name}`").alias(names[f.name]) for f in struct.fields)).join(F.broadcast(number_of), "file_path")  # else Spark may broadcast the rows, as it knows the sizes of files only
    n = groups.count()
    draft = f"{location}/data/draft-{uuid.uuid4()}"
    rows.repartitionById(n, F.col("number")).select(*(F.col(names[f.name]).alias(f.name, metadata=f.metadata) for f in struct.fields)).write.option("maxRecordsPerFile", 0).parquet(draft)
    parts = {int(name.split("-")[1]): name for name in storage.names(draft) if name.endswith(".parquet")}
    made = []
    for r in groups.collect():
        if r["number"] in parts:
            base = f"{location}/data" + (f"/{r['partition_key']}" if r["partition_key"] else "")
            made.append((f"{draft}/{parts[r['number']]}", f"{base}/compacted_{uuid.uuid4()}_from_{r['files']}_files.parquet", r["partition"]))
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda m: storage.move(m[0], m[1]), made))
    storage.delete(draft)
    paths = spark.createDataFrame([m[1:] for m in made], "file_path string, partition map<string,string>")
    written = once(introspect(paths.repartition(footer_tasks(len(made))), table.schema))
    before, after = groups.agg(F.sum("records")).first()[0], written.agg(F.sum("record_count")).first()[0]
    if before != (after or 0):
        for _, final, _ in made:
            storage.delete(final)
        raise CompactionFailed(f"{before} rows became {after}")
    return written.where("record_count > 0")
