"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast by `join_small` up to this many rows.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one that the session names in ``spark.checkpoint.dir``. Only a local
    session without one (tests) gets a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and go on from what was written.

    A written table survives lost executors, is compressed, and keeps nothing of the plan.
    """
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(large: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side that is usually small.

    `small` should be checkpointed, as it is counted first. Up to `limit` rows it is
    broadcast; beyond that both sides are shuffled and adaptive execution splits hot keys.
    """
    few = small.limit(limit + 1).count() <= limit
    return large.join(F.broadcast(small) if few else small, on, how)


def clear_tables(spark: SparkSession) -> int:
    """Delete the tables that this module wrote into the shared folder; returns how many there were.

    For the end of a job: results that were not written elsewhere still read from them.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs, gone = path.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for entry in fs.listStatus(path) if fs.exists(path) else []:
        stem, _, tag = entry.getPath().getName().rpartition("-")
        if stem and len(tag) == 32 and all(c in "0123456789abcdef" for c in tag):
            gone += fs.delete(entry.getPath(), True)
    return gone
