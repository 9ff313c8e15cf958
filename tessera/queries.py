"""The registered queries of the table layer and their SQL.

Each query works on real tables in a folder of its own: it registers or appends
the driver's data, operates, and reads back.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import IncompatibleSchema
from .operators.catalog import FolderCatalog
from .operators.compact import CompactOptions, compact_table, plan_compaction, plan_totals
from .operators.register import RegisterOptions, partition_summary, register, register_known
from .operators.retention import RetentionOptions, expire, plan_retention
from .operators.table import ADD_FIELDS, Table, append_or_create
from .plans.expr import col, not_
from .types import Schema

NOW_MS = 1_735_689_600_000
DAY_MS = 86_400_000


def workspace(spark: SparkSession) -> FolderCatalog:
    """A catalog in a fresh folder that executors share; local temporary ones go when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if base:
        at = f"{base.rstrip('/')}/warehouse-{uuid.uuid4().hex}"
    else:
        at = tempfile.mkdtemp(prefix="tessera-warehouse-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return FolderCatalog(spark, at)


def data(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered(spark: SparkSession, sf_dir: str, name: str) -> Table:
    """A table over the driver's file as it is."""
    catalog = workspace(spark)
    path = f"{sf_dir}/{name}.parquet"
    register(catalog, f"db.{name}", path if "://" in path or path.startswith("/") else f"/{path}", RegisterOptions(fail_if_missing=False), timestamp_ms=NOW_MS)
    return catalog.load_table(f"db.{name}")


def written(spark: SparkSession, df: DataFrame, spec: str = "", **options) -> Table:
    return append_or_create(workspace(spark), "db.t", df, spec, **options)[0]


def _lineitem_filter(where) -> callable:
    return lambda spark, sf_dir: registered(spark, sf_dir, "lineitem").scan(where)


def scan_full(spark, sf_dir):
    return registered(spark, sf_dir, "nation").scan()


def filter_date_literal(spark, sf_dir):
    return registered(spark, sf_dir, "lineitem").scan("l_shipdate >= '1999-01-01' AND l_returnflag IN ('A','R')")


def filter_null(spark, sf_dir):
    events = data(spark, sf_dir, "events").withColumn("event_type", F.expr("nullif(event_type, 'error')"))
    return written(spark, events, files_per_partition=2).scan("event_type IS NULL")


def filter_not_null(spark, sf_dir):
    events = data(spark, sf_dir, "events").withColumn("event_type", F.expr("nullif(event_type, 'error')"))
    return written(spark, events, files_per_partition=2).scan("event_type is not null and value > 50.5")


def by_id(spark, sf_dir):
    """Columns by field id instead of name."""
    return registered(spark, sf_dir, "orders").scan((col(1) >= 100) & (col(1) < 2000) & ~(col(3) == "F"))


def downstream_join_agg(spark, sf_dir):
    orders, customers = registered(spark, sf_dir, "orders").scan("o_orderdate >= '1996-01-01'"), registered(spark, sf_dir, "customer").scan()
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _partition_counts(name: str, source: str, transform: str):
    """Partition values as the inventory has them, with record counts; checks the write path of a transform."""

    def query(spark, sf_dir):
        table = written(spark, data(spark, sf_dir, name), f"{source}:{transform}=p")
        return table.files_with_stats().groupBy(F.col("partition")["p"].alias("p")).agg(F.sum("record_count").alias("n"))

    return query


def partition_pruned_scan(spark, sf_dir):
    table = written(spark, data(spark, sf_dir, "orders"), "o_orderdate:month=m,o_orderstatus", files_per_partition=1)
    return table.scan("o_orderdate >= '1996-03-15' AND o_orderdate < '1996-06-02' AND (o_orderstatus = 'O' OR o_orderstatus = 'F')")


def pruning_counts(spark, sf_dir):
    table = written(spark, data(spark, sf_dir, "events"), "event_type", files_per_partition=1)
    plan = table.plan("event_type IN ('click', 'purchase')")
    return plan.select("kept", "total")


def pruning_by_bounds(spark, sf_dir):
    """Files of one day each hold bounds of ts: a filter on ts skips the others without a partition on it."""
    table = written(spark, data(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "day=d", files_per_partition=1)
    return table.plan("ts >= '2024-01-10 00:00:00' AND ts < '2024-01-12 00:00:00'").select("kept", "total")


STAT_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def column_stats(spark, sf_dir):
    """Counts and bounds over all files of a table, from its inventory alone."""
    table = written(spark, data(spark, sf_dir, "orders"), files_per_partition=3)
    files, out = table.files_with_stats(), None
    for name in STAT_COLUMNS:
        f = table.schema.field(name)
        kind = table.schema.spark()[name].dataType.simpleString()
        text = (lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")) if f.type == "timestamp" else (lambda c: F.format_string("%.2f", c)) if f.type == "double" else (lambda c: c.cast("string"))
        one = files.agg(
            F.lit(name).alias("column_name"), F.sum("record_count").alias("n"), F.sum(F.col("value_counts")[f.id]).alias("n_values"), F.sum(F.col("null_value_counts")[f.id]).alias("n_nulls"),
            text(F.min(F.col("lower_bounds")[f.id].cast(kind))).alias("low"), text(F.max(F.col("upper_bounds")[f.id].cast(kind))).alias("high"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def table_totals(spark, sf_dir):
    return registered(spark, sf_dir, "lineitem").totals().select("n_records")


def append_two_commits(spark, sf_dir):
    orders = data(spark, sf_dir, "orders")
    table = written(spark, orders.where("o_orderstatus = 'O'"))
    table.append(orders.where("o_orderstatus = 'F'"))
    return table.scan()


def snapshot_log(spark, sf_dir):
    """Three appends: operations and running totals of the snapshots' summaries."""
    nation = data(spark, sf_dir, "nation")
    table = written(spark, nation.where("n_regionkey = 0"))
    for k in (1, 2):
        table.append(nation.where(f"n_regionkey = {k}"))
    summary = lambda k: F.col("summary")[k].cast("bigint").alias(k.replace("-", "_"))
    return table.snapshots().select("sequence_number", "operation", summary("added-records"), summary("total-records"), "is_current")


def time_travel(spark, sf_dir):
    nation = data(spark, sf_dir, "nation")
    table = written(spark, nation.where("n_regionkey < 2"))
    first = table.metadata.current_snapshot_id
    table.append(nation.where("n_regionkey >= 2"))
    return table.scan(snapshot_id=first)


def evolve_add_column(spark, sf_dir):
    events = data(spark, sf_dir, "events")
    table = written(spark, events.where("event_id % 2 = 0").select("event_id", "event_type"))
    table.append(events.where("event_id % 2 = 1").select("event_id", "event_type", "value"), ADD_FIELDS)
    return table.scan()


def register_idempotent(spark, sf_dir):
    catalog, path = workspace(spark), f"{sf_dir}/supplier.parquet"
    register(catalog, "db.supplier", path, RegisterOptions(fail_if_missing=False))
    register(catalog, "db.supplier", path, RegisterOptions(allow_noop=True))
    return catalog.load_table("db.supplier").scan()


def register_hive(spark, sf_dir):
    """Files below ``status=`` folders become a partitioned table, known by their folders."""
    catalog = workspace(spark)
    orders = data(spark, sf_dir, "orders")
    at = f"{catalog.warehouse}/incoming"
    orders.withColumn("status", F.col("o_orderstatus")).repartition("status").write.partitionBy("status").parquet(at)
    catalog.create_namespace("db")
    catalog.create_table("db.orders", Schema.of(orders.schema), "o_orderstatus=status")
    register(catalog, "db.orders", at)
    return catalog.load_table("db.orders").scan("o_orderstatus != 'P' AND o_totalprice > 100000")


def hive_path_values(spark, sf_dir):
    """Folder values of made-up paths, by the column form of the path parser."""
    from .sources.footer import partition_key_column

    paths = data(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("s3://b/t/data/year="), F.year("o_orderdate").cast("string"), F.lit("/month="), F.lpad(F.month("o_orderdate").cast("string"), 2, "0"), F.lit("/f="), F.col("o_orderkey").cast("string"), F.lit(".parquet")).alias("path"))
    return paths.select("o_orderkey", partition_key_column(F.col("path")).alias("partition_key"))


def commit_partition_summary(spark, sf_dir):
    table = written(spark, data(spark, sf_dir, "customer"), "c_mktsegment", files_per_partition=1)
    return partition_summary(table.files_with_stats())


def compact_preserves_rows(spark, sf_dir):
    table = written(spark, data(spark, sf_dir, "orders"), "o_orderstatus", files_per_partition=4)
    compact_table(table, CompactOptions())
    return table.scan()


def compact_file_counts(spark, sf_dir):
    """Files before and after compaction, by partition."""
    table = written(spark, data(spark, sf_dir, "orders"), "o_orderstatus", files_per_partition=4)
    count = lambda name: table.files_with_stats().groupBy(F.col("partition")["o_orderstatus"].alias("status")).agg(F.count(F.lit(1)).alias(name))
    before = count("n_before")
    compact_table(table, CompactOptions())
    return before.join(count("n_after"), "status")


def compact_plan(spark, sf_dir):
    """First fit by size over made-up files, one for each order."""
    files = data(spark, sf_dir, "orders").select(F.concat(F.lit("/t/data/status="), F.col("o_orderstatus"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".parquet")).alias("file_path"), (F.col("o_totalprice") * 100).cast("bigint").alias("file_size_in_bytes"))
    return plan_compaction(files, CompactOptions(target_bytes=1 << 26, max_input_bytes=1 << 25))


def rewrite_files(spark, sf_dir):
    """The file of one partition is replaced by other rows."""
    orders = data(spark, sf_dir, "orders")
    table = written(spark, orders.where("o_orderstatus IN ('O', 'F')"), "o_orderstatus", files_per_partition=1)
    old = table.files_with_stats().where(F.col("partition")["o_orderstatus"] == "F")
    table.transaction().rewrite(old, table.write_files(orders.where("o_orderstatus = 'P'"))).commit()
    return table.scan()


def pruned_percent(spark, sf_dir):
    """How many of a table's files a scan skips."""
    table = written(spark, data(spark, sf_dir, "orders"), "o_orderdate:year=y", files_per_partition=1)
    plan = table.plan("o_orderdate < '1995-01-01'")
    return plan.select("kept", "total", F.round("pruned_percent", 6).alias("pruned_percent"))


def partition_void(spark, sf_dir):
    """A void field: every row has the same, unknown partition value."""
    table = written(spark, data(spark, sf_dir, "customer"), "c_custkey:void=p", files_per_partition=1)
    return table.files_with_stats().groupBy(F.col("partition")["p"].alias("p")).agg(F.sum("record_count").alias("n"))


def split_offsets(spark, sf_dir):
    """Files with a split offset for their one row group, after the four bytes that begin a file; column sizes are known for every column."""
    table = written(spark, data(spark, sf_dir, "supplier"), files_per_partition=2)
    rows = table.files_with_stats().select(F.size("split_offsets").cast("bigint").alias("n_offsets"), F.col("split_offsets")[0].alias("first_offset"), F.size("column_sizes").cast("bigint").alias("n_columns"))
    return rows.groupBy("n_offsets", "first_offset", "n_columns").agg(F.count(F.lit(1)).alias("n_files"))


def time_travel_evolved(spark, sf_dir):
    """The first of two snapshots, between which a column came."""
    nation = data(spark, sf_dir, "nation")
    table = written(spark, nation.where("n_nationkey % 2 = 0").select("n_nationkey", "n_name"))
    first = table.metadata.current_snapshot_id
    table.append(nation.where("n_nationkey % 2 = 1").select("n_nationkey", "n_name", "n_regionkey"), ADD_FIELDS)
    return table.scan(snapshot_id=first)


def register_two_schemas(spark, sf_dir):
    """Files of two schemas: refused as they are, registered when fields may be added."""
    catalog = workspace(spark)
    customer, at = data(spark, sf_dir, "customer"), f"{catalog.warehouse}/incoming"
    customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name").write.parquet(at)
    customer.where("c_custkey % 2 = 1").select("c_custkey", "c_acctbal").write.mode("append").parquet(at)
    try:
        register(catalog, "db.customer", at, RegisterOptions(fail_if_missing=False))
        refused = False
    except IncompatibleSchema:
        refused = True
    register(catalog, "db.customer", at, RegisterOptions(fail_if_missing=False, policy=ADD_FIELDS))
    return catalog.load_table("db.customer").scan().select("c_custkey", "c_name", "c_acctbal", F.lit(refused).alias("refused"))


def register_metrics(spark, sf_dir):
    """Files registered by given metrics alone, one a nation, and what a filter on their bounds keeps; none is read."""
    customer = data(spark, sf_dir, "customer")
    facts = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("record_count"), F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))
    files = facts.select(
        F.concat(F.lit("/files/"), F.col("c_nationkey").cast("string"), F.lit(".parquet")).alias("file_path"), "record_count", (F.col("record_count") * 100).alias("file_size_in_bytes"),
        F.create_map(F.lit(1), F.col("low").cast("string")).alias("lower_bounds"), F.create_map(F.lit(1), F.col("high").cast("string")).alias("upper_bounds"),
    )
    catalog = workspace(spark)
    catalog.create_namespace("db")
    table = catalog.create_table("db.customer", Schema.of(customer.select("c_custkey", "c_name").schema))
    register_known(table, files)
    return table.plan("c_custkey <= 20").join(table.totals().select("n_records", "n_bytes"))


def paths_with_blanks(spark, sf_dir):
    """A table below a folder with blanks and percent signs, partitioned by such values, compacted and read back."""
    catalog = workspace(spark)
    orders = data(spark, sf_dir, "orders").withColumn("o_orderstatus", F.concat(F.lit("50% + "), "o_orderstatus"))
    table, _ = append_or_create(FolderCatalog(spark, f"{catalog.warehouse}/a b%20c"), "db.t", orders, "o_orderstatus", files_per_partition=4)
    compact_table(table, CompactOptions())
    return table.scan("o_orderstatus != '50% + P'")


def compaction_totals(spark, sf_dir):
    """What compaction of made-up files, one for each order, would do."""
    return plan_totals(compact_plan(spark, sf_dir), CompactOptions(target_bytes=1 << 26, max_input_bytes=1 << 25)).drop("n_output_files")


def _made_snapshots(spark, sf_dir):
    orders = data(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("snapshot_id"), (F.lit(NOW_MS) - F.col("o_custkey") * 3_600_000).alias("timestamp_ms"), (F.col("o_orderkey") == 7).alias("is_current"), F.when(F.col("o_orderkey") % 97 == 0, F.array(F.lit("tag"))).otherwise(F.array().cast("array<string>")).alias("refs"))


def snapshot_retention(spark, sf_dir):
    plan = plan_retention(_made_snapshots(spark, sf_dir), NOW_MS, RetentionOptions(older_than_ms=3 * DAY_MS, retain_last=20))
    return plan.select("snapshot_id", F.round("age_days", 6).alias("age_days"), "keep", "reason")


def expire_snapshots(spark, sf_dir):
    """Five daily commits; what is left when two must stay and three days count as recent."""
    nation = data(spark, sf_dir, "nation")
    table, _ = append_or_create(workspace(spark), "db.t", nation.where("n_regionkey = 0"), timestamp_ms=NOW_MS - 5 * DAY_MS)
    for k in range(1, 5):
        table.append(nation.where(f"n_regionkey = {k}"), timestamp_ms=NOW_MS - (5 - k) * DAY_MS)
    expire(table, RetentionOptions(older_than_ms=3 * DAY_MS, retain_last=2), NOW_MS)
    return table.snapshots().select("sequence_number", "timestamp_ms")


def stream_append(spark, sf_dir):
    """A stream of events appended batch by batch, then scanned."""
    from .streaming.sink import append_stream

    events = data(spark, sf_dir, "events")
    catalog = workspace(spark)
    at = f"{catalog.warehouse}/incoming"
    events.repartition(2).write.parquet(at)
    catalog.create_namespace("db")
    table = catalog.create_table("db.events", Schema.of(events.schema))
    query = append_stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(at), table, f"{catalog.warehouse}/progress", "events")
    query.awaitTermination()
    return table.refresh().scan("event_type = 'click'")


def entry(spark, sf_dir):
    return filter_date_literal(spark, sf_dir)


LINEITEM = {
    "filter_eq": ("l_returnflag = 'R'", None),
    "filter_neq": ("l_linestatus != 'O'", None),
    "filter_lt": ("l_quantity < 5", None),
    "filter_lte": ("l_quantity <= 5.0", None),
    "filter_gt": ("l_orderkey > 1000", None),
    "filter_gte": ("l_discount >= 0.1", None),
    "filter_in": ("l_linenumber IN (2, 4, 6)", None),
    "filter_and_or": ("(l_quantity < 3 OR l_tax >= 0.08) AND l_returnflag = 'N'", None),
    "filter_not": (not_((col("l_quantity") >= 10) | (col("l_returnflag") == "A")), "NOT (l_quantity >= 10 OR l_returnflag = 'A')"),
}
PARTITIONS = {
    "partition_identity": ("orders", "o_orderstatus", "identity", "o_orderstatus"),
    "partition_year": ("orders", "o_orderdate", "year", "CAST(year(o_orderdate) - 1970 AS VARCHAR)"),
    "partition_month": ("orders", "o_orderdate", "month", "CAST((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS VARCHAR)"),
    "partition_day": ("events", "ts", "day", "CAST(CAST(ts AS DATE) AS VARCHAR)"),
    "partition_hour": ("events", "ts", "hour", "CAST(epoch_us(ts) // 3600000000 AS VARCHAR)"),
    "partition_bucket": ("orders", "o_custkey", "bucket[8]", "CAST(CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 8 AS VARCHAR)"),
    "partition_truncate": ("customer", "c_mktsegment", "truncate[3]", "substr(c_mktsegment, 1, 3)"),
    "partition_truncate_int": ("customer", "c_custkey", "truncate[50]", "CAST(c_custkey - c_custkey % 50 AS VARCHAR)"),
}


def queries() -> dict:
    named = (
        scan_full, filter_date_literal, filter_null, filter_not_null, by_id, downstream_join_agg, partition_pruned_scan, pruning_counts, pruning_by_bounds, column_stats, table_totals,
        append_two_commits, snapshot_log, time_travel, evolve_add_column, register_idempotent, register_hive, hive_path_values, commit_partition_summary, compact_preserves_rows,
        compact_file_counts, compact_plan, rewrite_files, snapshot_retention, expire_snapshots, stream_append,
        pruned_percent, partition_void, split_offsets, time_travel_evolved, register_two_schemas, register_metrics, paths_with_blanks, compaction_totals,
    )
    return (
        {name: _lineitem_filter(where) for name, (where, _) in LINEITEM.items()}
        | {name: _partition_counts(*how[:3]) for name, how in PARTITIONS.items()}
        | {f.__name__: f for f in named}
    )


def oracle_sql() -> dict[str, str]:
    found = {name: f"SELECT * FROM lineitem WHERE {sql or where}" for name, (where, sql) in LINEITEM.items()}
    found |= {name: f"SELECT {sql} AS p, count(*) AS n FROM {t} GROUP BY 1" for name, (t, _, _, sql) in PARTITIONS.items()}
    stats = []
    for c in STAT_COLUMNS:
        text = {"o_totalprice": "printf('%.2f', {})", "o_orderdate": "strftime({}, '%Y-%m-%d %H:%M:%S')"}.get(c, "CAST({} AS VARCHAR)")
        stats.append(f"SELECT '{c}' AS column_name, count(*) AS n, count({c}) AS n_values, count(*) - count({c}) AS n_nulls, {text.format(f'min({c})')} AS low, {text.format(f'max({c})')} AS high FROM orders")
    packed = """
            WITH RECURSIVE f AS (SELECT 'status=' || o_orderstatus AS partition_key, '/t/data/status=' || o_orderstatus || '/' || o_orderkey || '.parquet' AS file_path, CAST(trunc(o_totalprice * 100) AS BIGINT) AS size FROM orders),
                 s AS (SELECT *, row_number() OVER (PARTITION BY partition_key ORDER BY size, file_path) AS i FROM f WHERE size < 33554432),
                 walk(partition_key, i, file_path, size, group_id, used) AS (
                     SELECT partition_key, i, file_path, size, CAST(0 AS BIGINT), size FROM s WHERE i = 1
                     UNION ALL
                     SELECT s.partition_key, s.i, s.file_path, s.size, CASE WHEN used + s.size <= 67108864 THEN group_id ELSE group_id + 1 END, CASE WHEN used + s.size <= 67108864 THEN used + s.size ELSE s.size END
                     FROM walk JOIN s ON s.partition_key = walk.partition_key AND s.i = walk.i + 1),
                 kept AS (SELECT *, count(*) OVER (PARTITION BY partition_key, group_id) AS members FROM walk)"""
    return found | {
        "compact_plan": f"{packed} SELECT partition_key, group_id, file_path, size AS file_size_in_bytes FROM kept WHERE members >= 3",
        "compaction_totals": f"{packed} SELECT count(DISTINCT partition_key || ':' || group_id) AS n_groups, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM kept WHERE members >= 3",
        "compact_file_counts": "SELECT o_orderstatus AS status, CAST(4 AS BIGINT) AS n_before, CAST(1 AS BIGINT) AS n_after FROM orders GROUP BY 1",
        "pruned_percent": "WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders) SELECT count(*) FILTER (y < 1995) AS kept, count(*) AS total, round(100.0 * count(*) FILTER (y >= 1995) / count(*), 6) AS pruned_percent FROM y",
        "partition_void": "SELECT CAST(NULL AS VARCHAR) AS p, count(*) AS n FROM customer",
        "split_offsets": "SELECT CAST(1 AS BIGINT) AS n_offsets, CAST(4 AS BIGINT) AS first_offset, (SELECT count(*) FROM (DESCRIBE supplier)) AS n_columns, CAST(2 AS BIGINT) AS n_files",
        "time_travel_evolved": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0",
        "register_two_schemas": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END AS c_acctbal, true AS refused FROM customer",
        "register_metrics": """
            WITH f AS (SELECT count(*) AS n, min(c_custkey) AS low FROM customer GROUP BY c_nationkey)
            SELECT count(*) FILTER (low <= 20) AS kept, count(*) AS total, 100.0 * count(*) FILTER (low > 20) / count(*) AS pruned_percent, CAST(sum(n) AS BIGINT) AS n_records, CAST(sum(n) * 100 AS BIGINT) AS n_bytes FROM f""",
        "paths_with_blanks": "SELECT * REPLACE ('50% + ' || o_orderstatus AS o_orderstatus) FROM orders WHERE o_orderstatus != 'P'",
        "scan_full": "SELECT * FROM nation",
        "filter_date_literal": "SELECT * FROM lineitem WHERE l_shipdate >= DATE '1999-01-01' AND l_returnflag IN ('A', 'R')",
        "filter_null": "SELECT * REPLACE (nullif(event_type, 'error') AS event_type) FROM events WHERE nullif(event_type, 'error') IS NULL",
        "filter_not_null": "SELECT * REPLACE (nullif(event_type, 'error') AS event_type) FROM events WHERE nullif(event_type, 'error') IS NOT NULL AND value > 50.5",
        "by_id": "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 2000 AND NOT (o_orderstatus = 'F')",
        "downstream_join_agg": "SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= DATE '1996-01-01' GROUP BY 1",
        "partition_pruned_scan": "SELECT * FROM orders WHERE o_orderdate >= DATE '1996-03-15' AND o_orderdate < DATE '1996-06-02' AND o_orderstatus IN ('O', 'F')",
        "pruning_counts": "SELECT count(DISTINCT event_type) FILTER (event_type IN ('click', 'purchase')) AS kept, count(DISTINCT event_type) AS total FROM events",
        "pruning_by_bounds": "SELECT count(DISTINCT CAST(ts AS DATE)) FILTER (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12') AS kept, count(DISTINCT CAST(ts AS DATE)) AS total FROM events",
        "column_stats": " UNION ALL ".join(stats),
        "table_totals": "SELECT count(*) AS n_records FROM lineitem",
        "append_two_commits": "SELECT * FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F'",
        "snapshot_log": """
            WITH c AS (SELECT n_regionkey AS k, count(*) AS n FROM nation WHERE n_regionkey < 3 GROUP BY 1)
            SELECT CAST(k + 1 AS BIGINT) AS sequence_number, 'append' AS operation, n AS added_records,
                   CAST(sum(n) OVER (ORDER BY k) AS BIGINT) AS total_records, k = 2 AS is_current FROM c""",
        "time_travel": "SELECT * FROM nation WHERE n_regionkey < 2",
        "evolve_add_column": "SELECT event_id, event_type, CASE WHEN event_id % 2 = 1 THEN value END AS value FROM events",
        "register_idempotent": "SELECT * FROM supplier",
        "register_hive": "SELECT * FROM orders WHERE o_orderstatus != 'P' AND o_totalprice > 100000",
        "hive_path_values": "SELECT o_orderkey, 'year=' || year(o_orderdate) || '/month=' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS partition_key FROM orders",
        "commit_partition_summary": "SELECT 'c_mktsegment=' || c_mktsegment AS partition_key, CAST(1 AS BIGINT) AS n_files, count(*) AS n_records FROM customer GROUP BY c_mktsegment",
        "compact_preserves_rows": "SELECT * FROM orders",
        "rewrite_files": "SELECT * FROM orders WHERE o_orderstatus IN ('O', 'P')",
        "snapshot_retention": f"""
            WITH s AS (SELECT o_orderkey AS snapshot_id, {NOW_MS} - o_custkey * 3600000 AS ts, o_orderkey = 7 AS cur, o_orderkey % 97 = 0 AS ref FROM orders),
                 r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, snapshot_id DESC) AS rank FROM s),
                 w AS (SELECT *, CASE WHEN cur THEN 'current' WHEN ref THEN 'referenced' WHEN rank <= 20 THEN 'newest' WHEN {NOW_MS} - ts < {3 * DAY_MS} THEN 'recent' ELSE 'expired' END AS reason FROM r)
            SELECT snapshot_id, round(({NOW_MS} - ts) / {DAY_MS}.0, 6) AS age_days, reason != 'expired' AS keep, reason FROM w""",
        "expire_snapshots": f"SELECT CAST(k AS BIGINT) AS sequence_number, CAST({NOW_MS} - (6 - k) * {DAY_MS} AS BIGINT) AS timestamp_ms FROM range(4, 6) t(k)",
        "stream_append": "SELECT * FROM events WHERE event_type = 'click'",
    }
