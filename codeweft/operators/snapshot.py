"""Snapshots of files by content hash: differences, upserts, deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(current: DataFrame, previous: DataFrame, key: str = "relative_path", digest: str = "sha256") -> DataFrame:
    """``key, change``: added, modified, deleted or unchanged, from one full outer join."""
    a = current.select(key, F.col(digest).alias("_now"), F.lit(True).alias("_here"))
    b = previous.select(key, F.col(digest).alias("_then"), F.lit(True).alias("_was"))
    change = (
        F.when(F.col("_was").isNull(), "added")
        .when(F.col("_here").isNull(), "deleted")
        .when(F.col("_now").eqNullSafe(F.col("_then")), "unchanged")
        .otherwise("modified")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def upsert_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """New rows by path, and the old ones of other paths."""
    return files.join(new.select("relative_path"), "relative_path", "left_anti").unionByName(new)


def delete_files(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths.select("relative_path"), "relative_path", "left_anti")


def latest(scans: DataFrame) -> DataFrame:
    """The scan that started last."""
    return scans.orderBy(F.desc("started_at"), F.desc("scan_id")).limit(1)
