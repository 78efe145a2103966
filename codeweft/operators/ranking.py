"""Places of rows within groups of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.storage import materialize

#: The lower bits of monotonically_increasing_id: the row's place in its partition.
PLACE_BITS = 33


def placed(df: DataFrame, group: str, order: list[Column | str], name: str = "position") -> DataFrame:
    """Adds the place of each row in its group, from 1, by ``order``, which must tell any two rows of a group apart.

    Two levels: all rows are dealt by ranges of (group, order) and sorted inside; a row's place is its place in its range,
    plus what earlier ranges hold of its group. The only window runs over one row per group and range. The result is
    written, since both levels must see the same ranges.
    """
    keys = [F.col(group), *order]
    row = F.monotonically_increasing_id()
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    sorted_ = materialize(sorted_.select("*", F.shiftright(row, PLACE_BITS).alias("_range"), row.bitwiseAND((1 << PLACE_BITS) - 1).alias("_place")), "placed")
    parts = sorted_.groupBy(group, "_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    found = sorted_.join(parts, [group, "_range"])
    return found.withColumn(name, (F.col("_place") + F.col("_shift")).cast("long")).drop("_range", "_place", "_shift")
