"""Tables between steps, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast, and the blocks that a larger one is listed in.
BROADCAST_ROWS, BLOCKS = 500_000, 32

_RUN = uuid.uuid4().hex[:12]


def folder(spark: SparkSession) -> str:
    """A subfolder of ``spark.checkpoint.dir``; on a local master without the setting, of a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/facts-{_RUN}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """*df* written as Parquet and read back, so that a loop's plan stays short and survives lost executors."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """*df*, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def paired(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """*left* joined with *right* where few keys hold most rows, so that pairs are many and tasks by key would be few.

    Rows of the left are dealt to tasks by all their columns, whatever their key; the right goes to
    every task, or, beyond BROADCAST_ROWS, to each block of the left.
    """
    left, right = staged(left, "left"), staged(right, "right")
    if right.count() <= BROADCAST_ROWS:
        tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return left.repartition(tasks, *left.columns).join(F.broadcast(right), on)
    block = F.pmod(F.xxhash64(*left.columns), F.lit(BLOCKS))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BLOCKS - 1).cast("bigint")))
    return left.withColumn("_block", block).join(right.withColumn("_block", each), [*on, "_block"]).drop("_block")
