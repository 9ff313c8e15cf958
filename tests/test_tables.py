import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import errors as E
from tessera.functions.transforms import Transform, parse_spec
from tessera.operators.catalog import FolderCatalog, next_metadata_path, parse_identifier
from tessera.operators.compact import CompactOptions, compact_table, first_fit, plan_compaction, plan_totals
from tessera.operators.register import RegisterOptions, parse_identity_spec, parse_values, register, register_known, upload
from tessera.operators.retention import DAY_MS, RetentionOptions, expire, plan_retention
from tessera.operators.table import ADD_FIELDS, append_or_create
from tessera.sources.footer import hive_values, introspect, partition_key, typed_values
from tessera.types import Field, ListType, MapType, Schema, StructType, compatible, max_id, merge, parse_type


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, name string")


def test_types_round_trip():
    schema = Schema(
        (
            Field(1, "id", "long", True), Field(2, "d", parse_type("decimal(10, 2)")), Field(3, "u", "uuid"), Field(4, "tags", ListType(5, "string")),
            Field(6, "props", MapType(7, "int", 8, "string")), Field(9, "at", StructType((Field(10, "street", "string", True), Field(11, "tod", "time")))), Field(12, "f", "fixed[16]"),
        ),
    )
    assert Schema.parse(json.loads(json.dumps(schema.json()))) == schema
    again = Schema.of(schema.spark())
    assert [f.type if isinstance(f.type, str) else type(f.type) for f in again.fields] == [f.type if isinstance(f.type, str) else type(f.type) for f in schema.fields]
    assert max_id(schema.fields) == 12
    for bad in ("decimal(50,2)", "varchar", "fixed[x]"):
        with pytest.raises(E.Unsupported):
            parse_type(bad)
    with pytest.raises(E.InvalidMetadata):
        Schema.of(T.StructType().add("a", T.LongType()), need_ids=True)


def test_merge_keeps_ids():
    base = Schema((Field(1, "id", "long", True), Field(2, "name", "string"), Field(3, "l", ListType(9, "int"))))
    wider = Schema((Field(1, "id", "long", True), Field(10, "age", "long", True)))
    merged = merge(base, wider)
    assert [(f.id, f.name, f.required) for f in merged.fields] == [(1, "id", True), (2, "name", False), (3, "l", False), (10, "age", False)]
    assert merged.schema_id == base.schema_id + 1
    assert compatible(base, wider) and not compatible(base, Schema((Field(1, "id", "int"),)))


def test_transforms_of_literals():
    import datetime as dt

    assert Transform.parse("Truncate[10]").literal(123, "int") == 120
    assert Transform.parse("truncate[5]").literal(-7, "int") == -10
    assert Transform.parse("truncate[5]").literal("hello world", "string") == "hello"
    assert Transform.parse("year").literal(dt.date(1969, 12, 31), "date") == -1
    assert Transform.parse("hour").literal(dt.datetime(1969, 12, 31, 23, 30), "timestamp") == -1
    assert Transform.parse("void").literal(3, "int") is None
    for bad in ("bucket[0]", "bucket", "weekly"):
        with pytest.raises(E.InvalidSpec):
            Transform.parse(bad)
    assert [str(f.transform) for f in parse_spec("ts:day, id:bucket[8]=b, name")] == ["day", "bucket[8]", "identity"]


def test_transform_columns_agree_with_literals(spark):
    import datetime as dt

    times = [dt.datetime(1969, 12, 31, 23, 59), dt.datetime(1970, 1, 1), dt.datetime(2024, 2, 29, 13, 5)]
    df = spark.createDataFrame([(t, i * 7 - 9, f"wörd{i}") for i, t in enumerate(times)], "t timestamp_ntz, i long, s string")
    for name, source, kind in [("year", "t", "timestamp"), ("month", "t", "timestamp"), ("day", "t", "timestamp"), ("hour", "t", "timestamp"), ("bucket[5]", "i", "long"), ("bucket[5]", "s", "string"), ("truncate[4]", "i", "long"), ("truncate[3]", "s", "string")]:
        how = Transform.parse(name)
        for row in df.select(F.col(source).alias("v"), how.column(F.col(source), kind).alias("p")).collect():
            assert how.literal(row["v"], kind) == row["p"], name


def test_append_scan_and_stats(catalog, spark):
    table, done = append_or_create(catalog, "db.people", people(spark, (1, "a"), (2, None), (3, "c")), files_per_partition=1)
    assert done.kind == "created" and done.snapshot.summary["added-records"] == "3"
    row = table.files_with_stats().first()
    assert row["record_count"] == 3 and row["value_counts"] == {1: 3, 2: 2} and row["null_value_counts"] == {1: 0, 2: 1}
    assert (row["lower_bounds"][1], row["upper_bounds"][1]) == ("1", "3")
    assert table.append(people(spark, (4, "d"))).kind == "appended"
    assert [s.sequence_number for s in table.metadata.snapshots] == [1, 2]
    assert table.metadata.snapshots[1].parent_id == table.metadata.snapshots[0].snapshot_id
    assert sorted(r["id"] for r in table.scan("name IS NOT NULL").collect()) == [1, 3, 4]
    assert table.scan("id = 1", residual=False).count() == 3
    assert table.append(people(spark)).snapshot is None


def test_scan_pushes_down(catalog, spark):
    table, _ = append_or_create(catalog, "db.people", people(spark, *((i, str(i)) for i in range(100))))
    plan = table.scan("id > 50").select("id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,50)]" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_schema_evolution(catalog, spark):
    table, _ = append_or_create(catalog, "db.people", people(spark, (1, "a")))
    wider = spark.createDataFrame([(2, "b", 30)], "id long, name string, age long")
    with pytest.raises(E.IncompatibleSchema):
        table.append(wider)
    assert table.append(wider, ADD_FIELDS).kind == "evolved"
    assert sorted((r["id"], r["age"]) for r in catalog.load_table("db.people").scan().collect()) == [(1, None), (2, 30)]
    with pytest.raises(E.IncompatibleSchema):
        table.append(spark.createDataFrame([("x", "b")], "id string, name string"), ADD_FIELDS)


def test_commits_race(catalog, spark):
    one, _ = append_or_create(catalog, "db.t", people(spark, (1, "a")))
    other = catalog.load_table("db.t")
    one.append(people(spark, (2, "b")))
    files = other.write_files(people(spark, (3, "c")))
    with pytest.raises(E.ConcurrentModification):
        other.transaction().append(files).commit(attempts=1)
    other.transaction().append(files).commit()
    assert sorted(r["id"] for r in other.scan().collect()) == [1, 2, 3]
    with pytest.raises(E.NothingToCommit):
        other.transaction().commit()


def test_rewrite_counts_and_lost_race(catalog, spark):
    table, _ = append_or_create(catalog, "db.t", people(spark, (1, "a"), (2, "b")))
    old = table.files_with_stats().select("file_path")
    rival = catalog.load_table("db.t")
    table.append(people(spark, (3, "c")))
    made = table.transaction().rewrite(old, table.write_files(people(spark, (9, "z")))).commit()
    assert made.summary["operation"] == "replace" and made.summary["deleted-records"] == "2" and made.summary["total-records"] == "2"
    assert sorted(r["id"] for r in table.scan().collect()) == [3, 9]
    with pytest.raises(E.ConcurrentModification):
        rival.transaction().rewrite(old, rival.write_files(people(spark, (8, "y")))).commit()
    assert sorted(r["id"] for r in table.refresh().scan().collect()) == [3, 9]


def test_register(catalog, spark, tmp_path):
    at = str(tmp_path / "in.parquet")
    people(spark, (1, "a"), (2, None)).coalesce(1).write.parquet(at)
    with pytest.raises(E.NotFound):
        register(catalog, "db.p", at)
    done = register(catalog, "db.p", at, RegisterOptions(fail_if_missing=False))
    assert (done.added_files, done.added_records, done.created) == (1, 2, True)
    with pytest.raises(E.NothingRegistered):
        register(catalog, "db.p", at)
    assert register(catalog, "db.p", at, RegisterOptions(allow_noop=True)).skipped == 1
    with pytest.raises(E.InvalidInput):
        register(catalog, "db.p", "shop/00017.parquet")
    (tmp_path / "empty").mkdir()
    with pytest.raises(E.InvalidFile):
        register(catalog, "db.p", str(tmp_path / "empty"))
    other = str(tmp_path / "other.parquet")
    spark.createDataFrame([("x",)], "id string").write.parquet(other)
    with pytest.raises(E.IncompatibleSchema):
        register(catalog, "db.p", other)


def test_bounds_cover_all_row_groups(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"id": list(range(100)), "s": [str(i) for i in range(100)]}), tmp_path / "g.parquet", row_group_size=10)
    row = introspect(spark.createDataFrame([(str(tmp_path / "g.parquet"),)], "file_path string")).first()
    assert (row["lower_bounds"][1], row["upper_bounds"][1], len(row["split_offsets"])) == ("0", "99", 10)


def test_hive_paths():
    path = "shop/region=7/open=True/since=1998-03-21/lane=0042/00017.parquet"
    assert typed_values(hive_values(path), {"region": "int", "open": "boolean", "since": "date", "lane": "long"}) == {"region": 7, "open": True, "since": dt.date(1998, 3, 21), "lane": 42}
    assert hive_values("t/a=x%20y/b=1=2/c=3.parquet") == {"a": "x y", "b": "1=2"}
    with pytest.raises(E.InvalidPartition):
        typed_values({"lane": "12b"}, {"lane": "long"})
    assert partition_key({"zone": 3, "lane": "0042"}) == "lane=0042/zone=3"
    assert parse_values("zone=3, lane=0042") == {"zone": "3", "lane": "0042"}


def test_compaction_plan(spark):
    assert first_fit([1, 2, 3, 4], 5) == [0, 0, 1, 2]
    sized = lambda n, size: spark.createDataFrame([(f"/t/data/dt=1/{i}.parquet", size) for i in range(n)], "file_path string, file_size_in_bytes long")
    assert plan_compaction(sized(5, 1024)).select("group_id").distinct().count() == 1
    assert plan_compaction(sized(2, 1024)).count() == 0
    assert plan_compaction(sized(5, 200 << 20)).count() == 0
    assert plan_totals(plan_compaction(sized(5, 1024))).first()[:] == (1, 5, 5120, 1)
    with pytest.raises(E.InvalidInput):
        CompactOptions(target_bytes=1 << 20, max_input_bytes=1 << 21)


def test_compaction(catalog, spark):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("string").alias("k"))
    table, _ = append_or_create(catalog, "db.t", df, "k", files_per_partition=4)
    before = table.totals().first()
    assert compact_table(table, CompactOptions(dry_run=True)).groups == 2
    done = compact_table(table)
    assert done.groups == 2 and done.files_in == before["n_files"] and table.totals().first()["n_files"] == 2
    assert sorted(r["id"] for r in table.scan("k = '1'").collect()) == list(range(1, 100, 2))
    assert table.plan("k = '1'").first()["kept"] == 1
    assert table.metadata.current.summary["operation"] == "replace"


def test_retention(catalog, spark):
    now = 1_700_000_000_000
    rows = [(i, now - i * DAY_MS, i == 3, ["tag"] if i == 9 else []) for i in range(12)]
    plan = plan_retention(spark.createDataFrame(rows, "snapshot_id long, timestamp_ms long, is_current boolean, refs array<string>"), now, RetentionOptions(5 * DAY_MS, 2))
    assert {r["snapshot_id"]: r["reason"] for r in plan.collect()} == {0: "newest", 1: "newest", 2: "recent", 3: "current", 4: "recent", 9: "referenced"} | {i: "expired" for i in (5, 6, 7, 8, 10, 11)}
    table, _ = append_or_create(catalog, "db.t", people(spark, (1, "a")), timestamp_ms=now - 30 * DAY_MS)
    for i in range(3):
        table.append(people(spark, (i, "b")), timestamp_ms=now - (20 - i) * DAY_MS)
    ids, lists = expire(table, RetentionOptions(DAY_MS, 1), now)
    assert len(ids) == 3 and len(lists) == 3 and len(table.refresh().metadata.snapshots) == 1 and table.scan().count() == 4
    with pytest.raises(E.InvalidMetadata):
        catalog.expire_snapshots(table, [table.metadata.current_snapshot_id])


def test_catalog(catalog, spark):
    catalog.create_namespace("a")
    with pytest.raises(E.AlreadyExists):
        catalog.create_namespace("a")
    schema = Schema((Field(1, "id", "long"), Field(2, "name", "string")))
    catalog.create_table("a.t", schema, "id:bucket[4]")
    with pytest.raises(E.AlreadyExists):
        catalog.create_table("a.t", schema)
    with pytest.raises(E.InvalidSpec):
        catalog.create_table("a.u", schema, "name:day")
    assert [r["name"] for r in catalog.list_tables("a").collect()] == ["t"] and catalog.list_namespaces().count() == 1
    with pytest.raises(E.NotFound):
        catalog.load_table("a.t").files()
    catalog.drop_table("a.t")
    assert not catalog.table_exists("a.t")
    assert parse_identifier("x.y.t") == (("x", "y"), "t")
    for bad in ("t", ".t", "a."):
        with pytest.raises(E.InvalidInput):
            parse_identifier(bad)
    assert next_metadata_path("/t/metadata/v6.metadata.json") == "/t/metadata/v7.metadata.json"
    assert next_metadata_path("/t/metadata/x.metadata.json").startswith("/t/metadata/")


def test_command_line(catalog, spark, tmp_path):
    from tessera.cli import bytes_text, run

    at = str(tmp_path / "in")
    people(spark, *((i, "n") for i in range(10))).repartition(4).write.parquet(at)
    do = lambda *a: json.loads(run(spark, ["--warehouse", catalog.warehouse, "--json", *a]))
    assert do("commit", "db.t", at, "--create")["added_records"] == 10
    assert do("catalog", "info")["namespaces"] == 1
    assert do("table", "list", "db") == [{"namespace": "db", "name": "t"}]
    assert do("table", "info", "db.t")["records"] == "10"
    assert len(do("table", "files", "db.t")) == 4
    assert do("table", "scan", "db.t", "--filter", "id > 100")["files_kept"] == 0
    assert do("table", "scan", "db.t", "--filter", "id > 7", "--limit", "5") in ([{"id": 8, "name": "n"}, {"id": 9, "name": "n"}], [{"id": 9, "name": "n"}, {"id": 8, "name": "n"}])
    assert do("compact", "db.t", "--dry-run")[0]["n_groups"] == 1
    assert do("compact", "db.t")["files_in"] == 4
    assert len(do("snapshot", "list", "db.t")) == 2
    assert do("snapshot", "cleanup", "db.t", "--older-than-days", "0", "--retain-last", "1")["expired"]
    assert do("namespace", "create", "other") == {"created": "other"}
    assert run(spark, ["--warehouse", catalog.warehouse, "namespace", "list"]).splitlines()[0] == "namespace"
    assert bytes_text(1536) == "1.50 KiB"
    assert do("commit", "db.t", at, "--upload")["added_files"] == 4 and do("table", "info", "db.t")["records"] == "20"
    with pytest.raises(E.InvalidFile):
        do("commit", "db.t", str(tmp_path / "nothing"), "--upload")


def test_paths_of_any_characters(spark, tmp_path):
    """Blanks, percent signs, plus signs and letters beyond ASCII in the warehouse and in partition values."""
    catalog = FolderCatalog(spark, str(tmp_path / "ware house %41 + größe"))
    keys = ["a b", "50%", "x+y", "naïve/é", "100%25", "k=v", "{[*?]}"]
    df = spark.range(140).select("id", F.element_at(F.array(*map(F.lit, keys)), (F.col("id") % len(keys) + 1).cast("int")).alias("k"))
    table, _ = append_or_create(catalog, "db.t", df, "k", files_per_partition=3)
    assert {r["partition"]["k"] for r in table.files_with_stats().collect()} == set(keys)
    assert table.totals().first()["n_files"] == 21
    rows = lambda: sorted(map(tuple, table.refresh().scan().collect()))
    want = sorted(map(tuple, df.collect()))
    assert rows() == want and table.plan("k = '50%'").first()["kept"] == 3
    done = compact_table(table)
    assert (done.groups, done.files_in, done.files_out) == (7, 21, 7)
    assert rows() == want and table.totals().first()["n_files"] == 7
    assert sorted(r["id"] for r in table.scan("k = 'x+y'").collect()) == list(range(2, 140, 7))
    old = table.files_with_stats().where(F.col("partition")["k"] == "50%").select("file_path")
    table.transaction().rewrite(old, table.write_files(df.where("id = 1"))).commit()
    assert sorted(r["id"] for r in table.refresh().scan("k = '50%'").collect()) == [1] and table.scan().count() == 121
    at = str(tmp_path / "in coming é")
    df.write.partitionBy("k").parquet(at)
    catalog.create_table("db.r", Schema.of(spark.createDataFrame([], "id long").schema))
    assert register(catalog, "db.r", at).added_records == 140 and catalog.load_table("db.r").scan().count() == 140


def test_compaction_that_meets_a_lost_file(catalog, spark):
    df = spark.range(120).select("id", (F.col("id") % 3).cast("string").alias("k"))
    table, _ = append_or_create(catalog, "db.t", df, "k", files_per_partition=3)
    lost = table.files_with_stats().where(F.col("partition")["k"] == "1").orderBy("file_path").first()["file_path"]
    catalog.storage.delete(lost)
    before = table.metadata.current_snapshot_id
    with pytest.raises(E.CompactionFailed):
        compact_table(table)
    assert table.refresh().metadata.current_snapshot_id == before
    done = compact_table(table, CompactOptions(allow_partial=True))
    assert (done.groups, done.files_in, len(done.failed)) == (2, 6, 1) and done.failed[0].endswith("=1")
    assert sorted(r["id"] for r in table.refresh().scan("k = '2'").collect()) == list(range(2, 120, 3))


def test_packing_of_many_files_is_shared(spark, monkeypatch):
    from tessera.operators import compact

    files = spark.range(500).select(F.format_string("/t/d=%d/%05d.parquet", F.col("id") % 2, "id").alias("file_path"), (1000 + F.col("id")).alias("file_size_in_bytes"))
    monkeypatch.setattr(compact, "FILES_A_TASK", 60)
    plan = plan_compaction(files, CompactOptions(target_bytes=20_000, max_input_bytes=10_000, max_group_bytes=20_000))
    groups = plan.groupBy("partition_key", "group_id").agg(F.sum("file_size_in_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert max(r["b"] for r in groups) <= 20_000 and min(r["n"] for r in groups) >= 3
    assert plan.select("file_path").distinct().count() == plan.count() > 450


def next_fit(files, capacity, least):
    """(partition_key, group_id, file_path, size) file by file."""
    out, groups = [], {}
    for path, size in sorted(files, key=lambda f: (f[1], f[0])):
        key = path.split("/")[3]
        group, used = groups.get(key, (0, 0))
        group, used = (group, used + size) if used + size <= capacity else (group + 1, size)
        groups[key] = group, used
        out.append((key, group, path, size))
    return sorted(r for r in out if sum(r[:2] == x[:2] for x in out) >= least)


@pytest.mark.parametrize("sizes", ["id * id % 97 + 1", "id % 9000 + 1000", "7", "id - 300", "if(id % 5 = 0, -40, id % 3)"])
def test_packing_does_not_depend_on_the_number_of_files_or_tasks(spark, monkeypatch, sizes):
    from tessera.operators import compact

    rows = spark.range(700).select(F.format_string("/t/data/d=%d/%05d.parquet", F.least(F.col("id") % 11, F.lit(2)), "id").alias("file_path"), F.expr(sizes).cast("bigint").alias("file_size_in_bytes"))
    options = CompactOptions(target_bytes=20_000, max_input_bytes=9_500, max_group_bytes=20_000)
    want = next_fit([tuple(r) for r in rows.collect() if r[1] < 9_500], 20_000, 3)
    monkeypatch.setattr(compact, "FILES_A_TASK", 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for tasks in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            assert sorted(map(tuple, plan_compaction(rows, options).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_totals_of_many_files_are_those_of_packing_file_by_file(spark, monkeypatch):
    from tessera.operators import compact

    monkeypatch.setattr(compact, "FILES_A_TASK", 60)
    rows = spark.range(400).select(F.format_string("/t/data/d=%d/%05d.parquet", F.col("id") % 2, "id").alias("file_path"), (F.col("id") * 37 % 8999 + 1).alias("file_size_in_bytes"))
    options = CompactOptions(target_bytes=20_000, max_input_bytes=9_500, max_group_bytes=20_000)
    want = next_fit([tuple(r) for r in rows.collect()], 20_000, 3)
    assert plan_totals(plan_compaction(rows, options), options).first()[:3] == (len({r[:2] for r in want}), len(want), sum(r[3] for r in want))


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_compaction_broadcasts_the_list_of_files_and_not_their_rows(catalog, spark, monkeypatch, threshold):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("string").alias("k"))
    table, _ = append_or_create(catalog, "db.t", df, "k", files_per_partition=4)
    frame, plans = type(df), []
    monkeypatch.setattr(frame, "repartitionById", lambda self, *a, f=frame.repartitionById: plans.append(self._jdf.queryExecution().sparkPlan().toString()) or f(self, *a))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert compact_table(table).groups == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "BroadcastHashJoin" in joins[0] and "BuildRight" in joins[0]
    assert sorted(r["id"] for r in table.refresh().scan().collect()) == list(range(100))


def test_commits_that_fail_leave_the_table_readable(catalog, spark, monkeypatch):
    table, _ = append_or_create(catalog, "db.t", people(spark, (1, "a")))
    ids = lambda: sorted(r["id"] for r in catalog.load_table("db.t").scan().collect())
    files = table.write_files(people(spark, (2, "b")))
    real = catalog.replace_metadata
    names = lambda: [n for n in catalog.storage.names(f"{table.metadata.location}/metadata") if not n.startswith(".")]
    # Before publication: what was written goes.
    before = names()
    with monkeypatch.context() as m:
        m.setattr(catalog.storage, "create", lambda path, text: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            table.transaction().append(files).commit()
    assert names() == before and ids() == [1]
    # During it, when nobody knows whether it was published: everything stays.
    for publish in (False, True):
        def lost(t, new, publish=publish):
            if publish:
                real(t, new)
            raise OSError("connection lost")

        with monkeypatch.context() as m:
            m.setattr(catalog, "replace_metadata", lost)
            with pytest.raises(OSError):
                table.transaction().append(files).commit()
        assert ids() == ([1, 2] if publish else [1])
    # After it: the snapshot is there and the table in hand is up to date.
    table.refresh()
    with monkeypatch.context() as m:
        m.setattr(catalog.storage, "read", lambda path, real=catalog.storage.read: (_ for _ in ()).throw(OSError("gone")) if "metadata.json" in path else real(path))
        made = table.transaction().append(table.write_files(people(spark, (3, "c")))).commit()
    assert table.metadata.current_snapshot_id == made.snapshot_id and ids() == [1, 2, 3]


def test_files_appear_whole(catalog, spark, tmp_path):
    storage, at = catalog.storage, str(tmp_path / "new" / "a b.json")
    storage.create(at, "x" * 100_000)
    assert storage.read(at) == "x" * 100_000 and storage.names(str(tmp_path / "new")) == ["a b.json"]
    with pytest.raises(E.ConcurrentModification):
        storage.create(at, "other")

    class Dies(type(storage)):
        def _write(self, files, path, text):
            stream = files.create(path, False)
            stream.write(bytearray(text[:10].encode()))
            stream.close()
            raise OSError("driver lost")

    with pytest.raises(OSError):
        Dies(spark).create(str(tmp_path / "new" / "b.json"), "whole text")
    assert not storage.exists(str(tmp_path / "new" / "b.json"))


def test_gzipped_metadata(catalog, spark):
    import gzip
    from pathlib import Path

    table, _ = append_or_create(catalog, "db.t", people(spark, (1, "a")))
    newest = Path(table.metadata_path)
    newest.with_name(newest.name.replace(".metadata.json", ".gz.metadata.json")).write_bytes(gzip.compress(newest.read_bytes()))
    newest.unlink()
    again = catalog.load_table("db.t")
    assert again.metadata_path.endswith(".gz.metadata.json") and again.append(people(spark, (2, "b"))).snapshot
    assert sorted(r["id"] for r in catalog.load_table("db.t").scan().collect()) == [1, 2]


def test_register_looks_at_every_file(catalog, spark, tmp_path):
    at = str(tmp_path / "in")
    people(spark, (1, "a")).coalesce(1).write.parquet(at)
    spark.createDataFrame([("x", 2.5)], "name string, weight double").coalesce(1).write.mode("append").parquet(at)
    with pytest.raises(E.IncompatibleSchema):
        register(catalog, "db.p", at, RegisterOptions(fail_if_missing=False))
    assert not catalog.table_exists("db.p")
    done = register(catalog, "db.p", at, RegisterOptions(fail_if_missing=False, policy=ADD_FIELDS))
    table = catalog.load_table("db.p")
    assert done.added_files == 2 and {f.name for f in table.schema.fields} == {"id", "name", "weight"}
    assert sorted(table.scan().select("id", "name", "weight").collect(), key=str) == sorted([(1, "a", None), (None, "x", 2.5)], key=str)
    assert [r["id"] for r in table.scan("weight IS NULL").collect()] == [1] and table.plan("weight < 1").first()["kept"] == 1  # the other file lacks the column
    spark.createDataFrame([("y",)], "id string").coalesce(1).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(E.IncompatibleSchema):
        register(catalog, "db.p", str(tmp_path / "bad"), RegisterOptions(policy=ADD_FIELDS))
    assert table.refresh().scan().count() == 2


def test_register_with_given_values_and_metrics(catalog, spark, tmp_path):
    at = str(tmp_path / "in" / "one.parquet")
    people(spark, (1, "a"), (2, "b")).coalesce(1).write.parquet(at)
    table = catalog_table = None
    catalog.create_namespace("db")
    table = catalog.create_table("db.t", Schema.of(people(spark).schema), "name=n,id:bucket[4]=b")
    with pytest.raises(E.InvalidPartition):
        register(catalog, "db.t", at)
    with pytest.raises(E.InvalidPartition, match="expected int"):
        register(catalog, "db.t", at, explicit={"n": "a", "b": "many"})
    source = next((tmp_path / "in" / "one.parquet").glob("*.parquet"))
    copied = upload(table, str(source))
    assert copied.startswith(f"{table.metadata.location}/data/") and copied != str(source)
    assert register(catalog, "db.t", [copied], explicit={"n": "a", "b": "2"}).added_records == 2
    catalog_table = catalog.load_table("db.t")
    assert catalog_table.files_with_stats().first()["partition"] == {"n": "a", "b": "2"}
    known = spark.createDataFrame([(str(source), 2, 700, {"n": "b", "b": "1"}, {1: "1"}, {1: "2"})], "file_path string, record_count long, file_size_in_bytes long, partition map<string,string>, lower_bounds map<int,string>, upper_bounds map<int,string>")
    done = register_known(catalog_table, known)
    assert (done.added_files, done.added_records) == (1, 2) and catalog_table.scan().count() == 4
    assert catalog_table.plan("id > 2").first()["kept"] == 0 or catalog_table.plan("id > 2").first()["kept"] == 1
    with pytest.raises(E.NothingRegistered):
        register_known(catalog_table, known)
    with pytest.raises(E.InvalidPartition):
        register_known(catalog_table, known.withColumn("partition", F.create_map(F.lit("n"), F.lit("b"))).withColumn("file_path", F.lit("/x.parquet")))
    with pytest.raises(E.InvalidInput):
        register_known(catalog_table, known.drop("record_count"))
    assert [str(f.transform) for f in parse_identity_spec("id:long", Schema.of(people(spark).schema))] == ["identity"]
    with pytest.raises(E.InvalidInput):
        parse_identity_spec("id:string", Schema.of(people(spark).schema))


def test_time_travel_has_the_columns_of_its_time(catalog, spark):
    table, _ = append_or_create(catalog, "db.t", people(spark, (1, "a")))
    first = table.metadata.current_snapshot_id
    table.append(spark.createDataFrame([(2, "b", 30)], "id long, name string, age long"), ADD_FIELDS)
    assert table.scan(snapshot_id=first).columns == ["id", "name"] and table.scan(snapshot_id=first).count() == 1
    assert table.scan().columns == ["id", "name", "age"]
    with pytest.raises(E.InvalidFilter):
        table.scan("age > 3", snapshot_id=first)


def test_void_partitions_and_bytes(catalog, spark):
    df = spark.createDataFrame([(1, bytearray(b"\x01\xff")), (2, None), (3, bytearray(b"z"))], "id long, b binary")
    table, _ = append_or_create(catalog, "db.t", df, "id:void=v")
    assert {r["partition"].get("v") for r in table.files_with_stats().collect()} == {None}
    assert [r["id"] for r in table.scan("b = X'01ff'").collect()] == [1] and table.scan("b IN (x'7A', X'')").count() == 1
    assert table.scan("id = 2").count() == 1
