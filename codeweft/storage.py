"""Shared storage: where intermediate tables go so that every executor can read them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only where that setting is absent and everything runs in one process a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="codeweft-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeweft-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table as read, dealt to all cores if its files give these fewer than two splits each.

    Files of one large row group are read by one task, which then does all that follows. A table of more splits is
    left as it is, so what is dealt is at most two splits of each core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


#: Rows of a part, in :func:`dealt`.
PART_ROWS = 1 << 16


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows, each of which costs much, dealt to all cores, and to parts of at most ``PART_ROWS`` rows or so.

    Splits by bytes are too large for such rows. Their number costs a count.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS)))
