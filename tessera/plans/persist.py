"""Computing something once, into storage that outlives a lost executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def once(df: DataFrame) -> DataFrame:
    """``df`` computed now, in the folder of spark.checkpoint.dir (a temporary one only in local sessions without it)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint(eager=True)
