"""Continuous ingest: files that arrive in a folder update the snapshot table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeweft.operators.snapshot import snapshot_diff, upsert_files


def start_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Read JSON rows(relative_path, sha256, ...) and keep ``target`` at the last version of each path.

    A batch writes a new version folder and then its changes, so a batch that is run again after a
    failure overwrites what it wrote and nothing else.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        new = batch.groupBy("relative_path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "relative_path"]), "version").alias("r")).select("relative_path", "r.*")
        before = f"{target}/files/v={batch_id - 1}"
        old = own.read.schema(new.schema).parquet(before) if batch_id else own.createDataFrame([], new.schema)
        merged = upsert_files(old, new)
        merged.write.mode("overwrite").parquet(f"{target}/files/v={batch_id}")
        changes = snapshot_diff(merged, old).where("change <> 'unchanged'")
        changes.write.mode("overwrite").parquet(f"{target}/changes/v={batch_id}")

    rows = spark.readStream.schema(schema).json(source)
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def level_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; what comes later than ``late`` no longer counts."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")
