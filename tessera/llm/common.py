"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import Storage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ``bytes.translate`` table that lower-cases A-Z and leaves every other byte.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session; only where that is unset (a
    local session, as in tests) a temporary folder is made and set.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into reliable storage.

    A lost executor then costs a reread, not a recomputation, and what reads
    the result twice sees the same rows.  Spark deletes the files when nothing
    refers to the data any more.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_in_loop(df: DataFrame) -> DataFrame:
    """``cut`` for loops: what the optimizer has inferred about columns is forgotten too.

    A checkpoint keeps the inferred constraints, and through renamings they
    double from one round of a loop to the next.
    """
    spark, once = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(once.toJavaRDD(), once.schema()), spark)


def thin(df: DataFrame, rows: int | None = None, per_partition: int = 50_000) -> DataFrame:
    """A computed ``df`` in as many partitions as its rows need, without moving them.

    What is small but comes in the partitions of a large shuffle would otherwise
    cost every later shuffle a file for each of them.
    """
    n = (df.count() if rows is None else rows) // per_partition + 1
    return df.coalesce(n)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle and checkpoint files that nothing refers to any more.

    It does so when the driver collects its garbage, which a driver that only
    plans jobs seldom needs to do by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class BatchLog:
    """Which attempts at which batches an index holds, as numbered files that are made once and whole.

    An index writes the rows of a batch under a name of their own (an attempt)
    and logs that name afterwards.  Rows of attempts that aren't logged don't
    count, so what a lost driver left behind does no harm, and a batch that is
    tried again after it was logged is judged by what came before it, as it was
    the first time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.storage, self.path = Storage(spark), f"{path}/_batches"

    def entries(self) -> list[dict]:
        """Logged batches in order: batch, attempt."""
        return [json.loads(self.storage.read(f"{self.path}/{n}")) for n in self.storage.names(self.path) if n.endswith(".json")]

    def before(self, batch: str) -> list[str]:
        """Attempts logged before ``batch``, all if it isn't logged yet."""
        found = []
        for e in self.entries():
            if e["batch"] == batch:
                break
            found.append(e["attempt"])
        return found

    def attempt(self, batch: str) -> str | None:
        return next((e["attempt"] for e in self.entries() if e["batch"] == batch), None)

    def add(self, batch: str, attempt: str) -> None:
        """Fails with ConcurrentModification if another batch takes the number at the same time."""
        self.storage.make_folder(self.path)
        at = f"{self.path}/{len(self.entries()) + 1:08d}.json"
        self.storage.create(at, json.dumps({"batch": batch, "attempt": attempt}))


def settled(spark: SparkSession, path: str, name: str, value: int) -> int:
    """The number kept under ``name`` beside an index: ``value`` if there is none yet."""
    storage, at = Storage(spark), f"{path}/_{name}.json"
    if not storage.exists(at):
        storage.make_folder(path)
        storage.create(at, json.dumps(value))
    return json.loads(storage.read(at))


def buckets_for(df: DataFrame, bucket_bytes: int = 64 << 20, least: int = 32) -> int:
    """Buckets of an index for data of the size of ``df``: the optimizer's estimate, or 2 KiB a row where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # what isn't read from files counts as endless
        size = 2048 * df.count()
    return max(least, min(1 << 16, -(-size // bucket_bytes)))


def by_bucket(df: DataFrame, buckets: int, column: str) -> DataFrame:
    """Rows in the tasks that write their buckets: each bucket becomes one sorted file."""
    return df.repartitionById(buckets, F.pmod(F.hash(column), F.lit(buckets)).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def unused(df: DataFrame, *names: str) -> dict[str, str]:
    """Working column names that no column of ``df`` clashes with."""
    taken = {c.lower() for c in df.columns}
    found = {}
    for name in names:
        own = f"_{name}"
        while own in taken:
            own = f"_{own}"
        taken.add(own)
        found[name] = own
    return found


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (one column); null equals null."""
    own = ids.toDF("_keep_id")
    return docs.join(own, docs["doc_id"].eqNullSafe(own["_keep_id"]), "left_semi")
