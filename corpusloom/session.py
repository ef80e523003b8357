"""Session helpers: lineage cuts, checked broadcasts, partition counts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that ``maybe_broadcast`` lets be broadcast.
BROADCAST_BYTES = 32 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset and
    the master is local, a temporary folder is used; on a cluster without it an
    error is raised, since a machine-local folder would be lost with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"corpusloom-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the estimated size is within ``limit``.

    Without the hint Spark joins by shuffle; results are the same either way.
    """
    return F.broadcast(df) if size_in_bytes(df) <= limit else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out again where a table comes in far fewer parts than there are cores,

    as a file of one row group does.  Tables of many parts are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores and size_in_bytes(df) > 1 << 19 else df
